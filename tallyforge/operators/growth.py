"""Growth over periods: against the year before, compound, and of parts against their whole. What cannot be computed is null, with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar

#: Growth beyond these shares is not believed.
SANE = (-0.9, 10.0)


def _placed(live: DataFrame) -> DataFrame:
    p = F.col("period")
    return live.withColumns({"__first": calendar.first_month(p), "__kind": calendar.calendar(p)}).where("__first IS NOT NULL")


def year_on_year(live: DataFrame) -> DataFrame:
    """Each fact against the one of the same length that began twelve months before: base, growth_pct (four places), reason, sane.

    reason: no_base, if there is none (gaps are not bridged), unit, if its currency is another, zero_base, negative_base; then growth_pct is null.
    sane: whether growth lies within SANE; null without growth. Facts whose period is none are left out; a key that is there twice is compared with its largest.
    """
    rows = _placed(live)
    money = F.coalesce("currency", F.lit("")) if "currency" in live.columns else F.lit("")
    by = Window.partitionBy("entity_id", "canonical_field", "__kind").orderBy("__first").rangeBetween(-12, -12)
    rows = rows.withColumn("__before", F.max(F.struct("value_normalised", money.alias("currency"))).over(by)).withColumn("__unit", money)
    base = F.col("__before.value_normalised")
    reason = F.when(base.isNull(), "no_base").when(F.col("__before.currency") != F.col("__unit"), "unit").when(base == 0, "zero_base").when(base < 0, "negative_base")
    grown = (F.col("value_normalised") - base).cast("decimal(24,6)") * 100 / base.cast("decimal(24,6)")
    rows = rows.withColumn("reason", reason).withColumn("growth_pct", F.when(reason.isNull(), F.round(F.when(base != 0, grown), 4)))
    sane = F.col("growth_pct").between(SANE[0] * 100, SANE[1] * 100)
    return rows.select("entity_id", "canonical_field", "period", F.col("value_normalised").alias("value"), base.alias("base"), "growth_pct", "reason", sane.alias("sane"))


def compound(live: DataFrame) -> DataFrame:
    """The yearly rate that leads from the first to the last period of each metric and kind of period: cagr_pct (four places), years, reason.

    reason: one_period, unit (another currency), not_positive (at either end); then cagr_pct is null. Gaps between are of no matter.
    """
    rows = _placed(live)
    money = F.coalesce("currency", F.lit("")) if "currency" in live.columns else F.lit("")
    end = F.struct("__first", F.col("value_normalised").alias("v"), "period", money.alias("unit"))
    ends = rows.groupBy("entity_id", "canonical_field", F.col("__kind").alias("kind")).agg(F.min(end).alias("a"), F.max(end).alias("b"))
    years = (F.col("b.__first") - F.col("a.__first")) / 12
    reason = F.when(years == 0, "one_period").when(F.col("a.unit") != F.col("b.unit"), "unit").when((F.col("a.v") <= 0) | (F.col("b.v") <= 0), "not_positive")
    rate = (F.pow(F.col("b.v").cast("double") / F.when(F.col("a.v") != 0, F.col("a.v").cast("double")), 1 / F.when(years != 0, years)) - 1) * 100
    return ends.select("entity_id", "canonical_field", F.col("a.period").alias("from_period"), F.col("b.period").alias("to_period"), years.alias("years"), F.when(reason.isNull(), F.round(rate, 4)).alias("cagr_pct"), reason.alias("reason"))


def parts(live: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Each fiscal year of a metric that has quarters or months as well: their sum, how many there are, and whether a whole set adds up to the year (null for a part of one)."""
    rows = _placed(live).where("period LIKE 'FY%'").withColumn("__months", calendar.months(F.col("period")))
    year = F.floor((F.col("__first") - 3) / 12)
    is_year = F.col("__months") == 12
    found = rows.groupBy("entity_id", "canonical_field", year.alias("__year")).agg(
        F.max(F.when(is_year, F.struct("period", "value_normalised"))).alias("whole"),
        *[x for n, m in (("quarters", 3), ("months", 1)) for x in (F.sum(F.when(F.col("__months") == m, F.col("value_normalised"))).alias(f"{n}_sum"), F.count_if(F.col("__months") == m).alias(n))],
    )
    shape = F.explode(F.array(*[F.struct(F.lit(n).alias("grain"), F.col(n).alias("n"), F.lit(12 // m).alias("full"), F.col(f"{n}_sum").alias("total")) for n, m in (("quarters", 3), ("months", 1))]))
    rows = found.where("whole IS NOT NULL").select("entity_id", "canonical_field", "whole.*", shape.alias("s")).where("s.n > 0")
    off = F.abs(F.col("s.total") - F.col("value_normalised")).cast("double")
    agrees = F.when(F.col("s.n") == F.col("s.full"), off <= tolerance * F.abs(F.col("value_normalised")).cast("double"))
    return rows.select("entity_id", "canonical_field", "period", F.col("s.grain").alias("grain"), F.col("s.n").alias("n"), F.col("value_normalised").alias("value"), F.col("s.total").alias("total"), agrees.alias("agrees"))
