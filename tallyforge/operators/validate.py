"""Validation of facts (entity_id, canonical_field, period, value_normalised, currency, staging_id): issues as rows, never an exception."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import MAGNITUDE, PERCENTAGES, POSITIVE, SWINGING
from .derive import wide

CHECKS = ("sum_relation", "margin_consistency", "magnitude", "period_swing", "sign")
COLUMNS = ("check", "severity", "entity_id", "canonical_field", "period", "value")


def _issues(df: DataFrame, check: str, severity, metric, value) -> DataFrame:
    return df.select(F.lit(check).alias("check"), severity.alias("severity"), "entity_id", metric.alias("canonical_field"), "period", value.cast("double").alias("value"))


def sum_relation(facts: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Net revenue against gross less returns."""
    t = wide(facts, ["revenue_gross", "returns_refunds", "revenue_net"]).where("revenue_gross IS NOT NULL AND revenue_net IS NOT NULL")
    expected = F.col("revenue_gross") - F.coalesce("returns_refunds", F.lit(0))
    off = (expected != 0) & (F.abs(F.col("revenue_net") - expected).cast("double") / F.abs(expected).cast("double") > tolerance)
    return _issues(t.where(off), "sum_relation", F.lit("warning"), F.lit("revenue_net"), F.col("revenue_net"))


def margin_consistency(facts: DataFrame, points: float = 0.5) -> DataFrame:
    """A reported gross margin against gross profit over net revenue."""
    t = wide(facts, ["gross_margin_pct", "gross_profit", "revenue_net"]).where("gross_margin_pct IS NOT NULL AND gross_profit IS NOT NULL AND revenue_net > 0")
    made = F.col("gross_profit").cast("double") / F.col("revenue_net").cast("double") * 100
    return _issues(t.where(F.abs(F.col("gross_margin_pct").cast("double") - made) > points), "margin_consistency", F.lit("warning"), F.lit("gross_margin_pct"), F.col("gross_margin_pct"))


def magnitude(facts: DataFrame) -> DataFrame:
    """Amounts above their bound (error) or below it (warning); rules by currency, as literals in the plan."""
    low, high, inr = MAGNITUDE["INR"]
    other_low, other_high, other = MAGNITUDE["other"]
    rupees = F.col("currency") == "INR"
    ruled = F.when(rupees, F.col("canonical_field").isin(*inr)).otherwise(F.col("canonical_field").isin(*other)) & ~F.col("canonical_field").isin(*PERCENTAGES)
    v = F.col("value_normalised").cast("double")
    severity = F.when(v > F.when(rupees, high).otherwise(other_high), "error").when(v < F.when(rupees, low).otherwise(other_low), "warning")
    return _issues(facts.where(ruled & severity.isNotNull()), "magnitude", severity, F.col("canonical_field"), F.col("value_normalised"))


def period_swing(facts: DataFrame, *, by_grain: bool = True) -> DataFrame:
    """A value more than ten times, or less than a tenth, of the one before it; periods of one grain are compared in order of time unless by_grain is off."""
    year = F.when(F.substring("period", 3, 2).try_cast("int") >= 70, 1900).otherwise(2000) + F.substring("period", 3, 2).try_cast("int")
    grain, order = F.substring("period", 5, 2), [year, F.col("period"), F.col("staging_id")]
    by = ["entity_id", "canonical_field"]
    if not by_grain:
        grain, order = F.lit(""), [F.col("period"), F.col("staging_id")]
    rows = facts.where(F.col("canonical_field").isin(*SWINGING)).withColumn("grain", grain)
    before = F.lag("value_normalised").over(Window.partitionBy(*by, "grain").orderBy(*order))
    rows = rows.withColumn("before", before).where("before <> 0 AND value_normalised <> 0")
    rate = F.abs(F.col("value_normalised").cast("double") / F.col("before").cast("double"))
    return _issues(rows.where((rate > 10) | (rate < 0.1)), "period_swing", F.lit("warning"), F.col("canonical_field"), F.col("value_normalised"))


def sign(facts: DataFrame) -> DataFrame:
    """Clearly negative values of metrics that are not negative."""
    bad = F.col("canonical_field").isin(*POSITIVE) & (F.col("value_normalised") < -1000)
    return _issues(facts.where(bad), "sign", F.lit("warning"), F.col("canonical_field"), F.col("value_normalised"))


def validate(staging: DataFrame, live: DataFrame | None = None, *, file_ids: list[int] | None = None) -> DataFrame:
    """All issues. Relations are checked on an entity's staged facts, or on its live ones if it has none staged."""
    if file_ids is not None:
        staging = staging.where(F.col("file_id").isin(*file_ids))
    facts = staging
    if live is not None:
        columns = ["entity_id", "canonical_field", "period", "value_normalised", "currency", "staging_id"]
        facts = staging.select(*columns).union(live.join(staging.select("entity_id").distinct(), "entity_id", "left_anti").select(*columns))
    return reduce(DataFrame.union, [sum_relation(facts), margin_consistency(facts), magnitude(staging), period_swing(facts), sign(staging)])


def summary(issues: DataFrame) -> DataFrame:
    """For each check its errors and warnings, and whether it passed; checks without issues too."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(c,) for c in CHECKS], "check string")
    counts = issues.groupBy("check").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    joined = F.broadcast(every).join(counts, "check", "left")
    return joined.select("check", F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def report(issues: DataFrame) -> str:
    """The summary as text."""
    lines = [f"{'PASS' if r['passed'] else 'FAIL'} {r['check']}: {r['errors']} errors, {r['warnings']} warnings" for r in summary(issues).orderBy("check").collect()]
    return "\n".join(lines)
