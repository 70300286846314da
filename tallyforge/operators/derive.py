"""Derived metrics from the formula table: one pivot of the operands instead of a self-join for each formula."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_id
from ..registry import FORMULAS
from .store import VALUE


def apply_formula(kind: str, a, b):
    """difference, sum, or percent (null for a zero divisor; four places)."""
    if kind == "difference":
        return (a - b).cast(VALUE)
    if kind == "sum":
        return (a + b).cast(VALUE)
    ratio = a.cast("decimal(24,6)") * 100 / b.cast("decimal(24,6)")
    return F.when(b != 0, F.round(ratio, 4).cast(VALUE))


_formulas: list[tuple[str, str, str, str]] = []


def register_formula(name: str, a: str, b: str, kind: str) -> None:
    """A derived metric of this session, computed after the others: difference, sum or percent of two metrics."""
    if kind not in ("difference", "sum", "percent"):
        raise ValueError(f"no kind of formula {kind}")
    _formulas.append((name, a, b, kind))


def clear_formulas() -> None:
    _formulas.clear()


#: Where a fact comes from.
LINEAGE = ("source_file_id", "staging_id", "cell_reference", "source_sheet")


def wide(live: DataFrame, metrics: list[str], *more: str) -> DataFrame:
    """One row for each entity and period with a column for each metric: a single shuffle, combined before it."""
    pick = lambda m: F.max(F.when(F.col("canonical_field") == m, F.col("value_normalised")))
    return live.where(F.col("canonical_field").isin(*metrics)).groupBy("entity_id", "period", *more).agg(*[pick(m).alias(m) for m in metrics])


def _traced(live: DataFrame, metrics: list[str], kept: list[str]) -> DataFrame:
    """wide() with where each value comes from beside it."""
    value, origin = F.col("value_normalised"), F.struct(*kept)
    pick = lambda m: F.max(F.when(F.col("canonical_field") == m, F.struct(value.alias("v"), origin.alias("o"))))
    rows = live.where(F.col("canonical_field").isin(*metrics)).groupBy("entity_id", "period", "entity_slug").agg(*[pick(m).alias(f"__{m}") for m in metrics])
    return rows.select("entity_id", "period", "entity_slug", *[F.col(f"__{m}.v").alias(m) for m in metrics], *[F.col(f"__{m}.o").alias(f"__of_{m}") for m in metrics])


def derive(live: DataFrame, formulas=None, *, replace_reported: bool = False) -> DataFrame:
    """The derived facts of live facts; a reported one is kept unless replace_reported. Needs fact_id, entity_slug and the key columns.

    Where the columns of LINEAGE are there, a derived fact has those of its first operand, which has them of its own first operand if it is derived.
    """
    formulas = [*FORMULAS, *_formulas] if formulas is None else formulas
    used = list(dict.fromkeys(x for f in formulas for x in (f[1], f[2], f[0])))
    kept = [c for c in LINEAGE if c in live.columns]
    table = wide(live, used, "entity_slug") if not kept else _traced(live, used, kept)
    have = {m: F.col(m) for m in used}
    origin = {m: F.col(f"__of_{m}") for m in used} if kept else {}
    for name, a, b, kind in formulas:
        # an operand that is itself derived stands for its reported value where there is one
        made = f"__{name}"
        table = table.withColumn(made, apply_formula(kind, have[a], have[b]))
        have[name] = F.coalesce(F.col(made), F.col(name)) if replace_reported else F.coalesce(F.col(name), F.col(made))
        if kept:
            table = table.withColumn(f"__from_{name}", origin[a])
            first, second = (f"__from_{name}", f"__of_{name}") if replace_reported else (f"__of_{name}", f"__from_{name}")
            origin[name] = F.coalesce(F.col(first), F.col(second))
    parts = []
    for name, a, b, kind in formulas:
        wanted = F.col(f"__{name}").isNotNull() & (F.lit(replace_reported) | F.col(name).isNull())
        parts.append(
            F.when(wanted, F.struct(
                F.lit(name).alias("canonical_field"), F.col(f"__{name}").alias("value_normalised"),
                F.lit("PERCENTAGE" if kind == "percent" else None).cast("string").alias("currency"), F.lit("%" if kind == "percent" else None).cast("string").alias("original_unit"),
                F.array(F.lit(a), F.lit(b)).alias("derived_from"), *([F.col(f"__from_{name}").alias("origin")] if kept else []),
            ))
        )
    facts = table.select("entity_id", "entity_slug", "period", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("f")).select("entity_id", "entity_slug", "period", "f.*")
    if kept:
        facts = facts.select("*", "origin.*").drop("origin")
    return facts.withColumn("is_derived", F.lit(True)).withColumn("fact_id", fact_id(F.col("entity_slug"), F.col("period"), F.col("canonical_field")))
