"""Conflicts between sources, their resolution, and promotion to live facts: pure functions of staging and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fact_id

KEY = ["entity_id", "canonical_field", "period"]


def _scoped(staging: DataFrame, file_ids: list[int] | None) -> DataFrame:
    return staging if file_ids is None else staging.where(F.col("file_id").isin(*file_ids))


def detect_conflicts(staging: DataFrame, files: DataFrame, *, tolerance: float = 0.0, file_ids: list[int] | None = None) -> DataFrame:
    """Keys with more than one value: n_values, staging_ids and options (staging_id, value, source), all in one aggregation.

    tolerance: values within this share of the largest agree (0: any two different values conflict). file_ids: only facts of these files.
    """
    staging = _scoped(staging, file_ids)
    rows = staging.join(files.select("file_id", "filename"), "file_id") if "filename" not in staging.columns else staging
    low, high = F.min("value_normalised"), F.max("value_normalised")
    grouped = rows.groupBy(*KEY).agg(
        F.count_distinct("value_normalised").alias("n_values"), low.alias("low"), high.alias("high"),
        F.sort_array(F.collect_list(F.struct("staging_id", F.col("value_normalised").cast("string").alias("value"), F.col("filename").alias("source")))).alias("options"),
    )
    apart = (F.col("high") - F.col("low")).cast("double") > tolerance * F.greatest(F.abs("high"), F.abs("low")).cast("double")
    return grouped.where((F.col("n_values") > 1) & apart).select(*KEY, "n_values", F.transform("options", lambda o: o["staging_id"]).alias("staging_ids"), "options")


def resolve(conflicts: DataFrame, policy: str = "first", pattern: str | None = None) -> DataFrame:
    """A decision for each conflict. first: the first option; prefer: the first whose source matches the pattern, else the first; open: none."""
    first = F.col("options")[0]["staging_id"]
    if policy == "open":
        return conflicts.select(*KEY, F.lit(None).cast("long").alias("resolution_staging_id"), F.lit("OPEN").alias("state"))
    if policy == "prefer":
        first = F.coalesce(F.get(F.filter("options", lambda o: F.lower(o["source"]).rlike(pattern.lower())), F.lit(0))["staging_id"], first)
    elif policy != "first":
        raise ValueError(f"no policy {policy}")
    return conflicts.select(*KEY, first.alias("resolution_staging_id"), F.lit("RESOLVED").alias("state"))


def settled(decisions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Decisions, with what users have resolved in their place. resolutions: the key, resolution_staging_id and resolved_by, once for each key."""
    said = resolutions.select(*KEY, F.col("resolution_staging_id").alias("said"), "resolved_by")
    joined = decisions.join(said, KEY, "left")
    state = F.when(F.col("said").isNotNull(), "RESOLVED").otherwise(F.col("state"))
    return joined.select(*KEY, F.coalesce("said", "resolution_staging_id").alias("resolution_staging_id"), state.alias("state"), "resolved_by")


def promote(staging: DataFrame, decisions: DataFrame, slugs: DataFrame, *, compat: bool = False, file_ids: list[int] | None = None) -> DataFrame:
    """One live fact for each key: the decided row, else the one staged first; keys with an open conflict are left out, unless a fact is put forward for it, which goes live with a mark. file_ids: only facts of these files."""
    staging = _scoped(staging, file_ids)
    open_keys = decisions.where("state = 'OPEN' AND resolution_staging_id IS NULL").select(*KEY)
    decided = decisions.where("resolution_staging_id IS NOT NULL").select(*KEY, "resolution_staging_id", (F.col("state") == "OPEN").alias("marked"))
    rows = staging.join(open_keys, KEY, "left_anti").join(decided, KEY, "left")
    order = F.struct((F.col("staging_id") != F.coalesce("resolution_staging_id", F.lit(-1))).alias("other"), "staging_id")
    kept = [c for c in ("value_normalised", "currency", "original_unit", "conversion_factor", "conversion_applied", "file_id", "staging_id", "cell_reference", "source_sheet") if c in staging.columns]
    many = F.count("*") > 1 if compat else F.count_distinct("value_normalised") > 1
    best = rows.groupBy(*KEY).agg(F.min_by(F.struct(*kept), order).alias("best"), many.alias("many"), F.max("marked").alias("marked"))
    live = best.join(slugs.select("entity_id", "entity_slug"), "entity_id")
    note = F.when(F.col("marked"), F.lit("sources disagree")).when(F.col("many"), F.lit("chosen among several sources"))
    out = live.select(
        fact_id(F.col("entity_slug"), F.col("period"), F.col("canonical_field")).alias("fact_id"), "entity_slug", *KEY, "best.*",
        F.lit(False).alias("is_derived"), F.array().cast("array<string>").alias("derived_from"), note.alias("authoritative_note"),
    )
    return out.withColumnRenamed("file_id", "source_file_id") if "file_id" in kept else out
