"""Where a figure comes from: all cells behind a fact, however often it was derived, with what a citation has to state of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_id
from .agreement import SOURCES, source_rank
from .reconcile import KEY

#: Formulas upon formulas; more than any registry has, so that a circle ends.
DEEPEST = 20


def closure(live: DataFrame) -> DataFrame:
    """fact_id and leaf_id (a fact that is not derived) for each fact, with depth, the fewest formulas between them; a reported fact is its own leaf at depth 0.

    live: fact_id, entity_slug, period, is_derived and derived_from, the metrics that a fact was made from. Operands that are not live have no leaf; a
    circle of formulas ends at DEEPEST. The recursion is over (fact, operand) pairs, so its rows are bounded by facts times operands.
    """
    spark = live.sparkSession
    made = live.where("is_derived").select("fact_id", F.explode("derived_from").alias("metric"), "entity_slug", "period")
    edges = made.select("fact_id", fact_id(F.col("entity_slug"), F.col("period"), F.col("metric")).alias("operand")).distinct()
    kinds = live.select("fact_id", "is_derived").distinct()
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # what bounds the recursion is its depth
    return spark.sql(
        """
        WITH RECURSIVE behind(fact_id, at, depth) AS (
          SELECT fact_id, fact_id, 0 FROM {kinds}
          UNION ALL SELECT b.fact_id, e.operand, b.depth + 1 FROM behind b JOIN {edges} e ON b.at = e.fact_id WHERE b.depth < {deepest})
        SELECT b.fact_id, b.at AS leaf_id, min(b.depth) AS depth FROM behind b JOIN {kinds} k ON k.fact_id = b.at AND NOT k.is_derived GROUP BY b.fact_id, b.at""",
        kinds=kinds, edges=edges, deepest=DEEPEST,
    )


def envelopes(live: DataFrame, staging: DataFrame, files: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """For each live fact and each cell behind it, what its citation states: file, sheet, cell, labels, the value as it stood there and as it is stored, how
    one came from the other, when, how sure it is, its source's rank, and the staged facts that contradict it.

    confidence is high for an audited source without contradiction, low with one, else medium.
    """
    leaves = live.select(F.col("fact_id").alias("leaf_id"), *KEY, "staging_id", "source_file_id", "source_sheet", "cell_reference", F.col("value_normalised").alias("normalised_value"), "currency", "original_unit", "conversion_factor")
    cells = staging.select("staging_id", F.col("row_context").alias("row_label"), "raw_header", F.col("raw_value").alias("original_value"))
    about = files.select(F.col("file_id").alias("source_file_id"), F.col("filename").alias("source_file"), *[c for c in ("ingested_at",) if c in files.columns])
    found = closure(live).join(leaves, "leaf_id").join(cells, "staging_id", "left").join(about, "source_file_id", "left")
    if conflicts is not None:
        against = conflicts.select(*KEY, F.col("staging_ids").alias("__all"), F.col("state").alias("conflict"))
        found = found.join(against, KEY, "left")
        others = F.filter(F.coalesce("__all", F.array().cast("array<bigint>")), lambda i: i != F.col("staging_id"))
    else:
        found, others = found.withColumn("conflict", F.lit(None).cast("string")), F.array().cast("array<bigint>")
    rank = source_rank(F.coalesce("source_file", F.lit("")))
    factor = F.col("conversion_factor").cast("decimal(20,4)")
    how = F.when(F.col("conversion_factor") == 1, "as it is").otherwise(F.concat(F.lit("times "), F.regexp_replace(factor.cast("string"), r"\.?0+$", "")))
    sure = F.when(F.size(others) > 0, "low").when(rank == 0, "high").otherwise("medium")
    return found.select(
        "fact_id", "leaf_id", "depth", "entity_id", "canonical_field", "period", "source_file", F.col("source_sheet").alias("sheet"), F.col("cell_reference").alias("cell"),
        "row_label", F.when(F.col("raw_header") == F.col("row_label"), F.col("period")).otherwise(F.col("raw_header")).alias("column_label"),
        "original_value", "original_unit", "normalised_value", F.col("currency").alias("normalised_unit"), how.alias("transformation"),
        *[c for c in ("ingested_at",) if c in files.columns], sure.alias("confidence"), F.element_at(F.array(*map(F.lit, [*SOURCES, "other"])), rank + 1).alias("source_kind"), others.alias("conflicts_with"), "conflict",
    )
