"""Do sources agree? Values of one key are put into classes by the metric's own band, and classes are ranked by their best source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..registry import METRICS
from .reconcile import KEY

# Sources in order of trust, and what a file's name says of them.
SOURCES = {"audited": "audited", "tally": "tally", "narrative": "narrative|owner|management|mis|deck", "ledger": "ledger|customer"}
# The share by which values of a metric may differ and still agree; counts and percentages have to be equal.
BANDS = {"revenue": 0.005, "profitability": 0.01, "cost": 0.01, "balance_sheet": 0.01}


def source_rank(filename: Column) -> Column:
    """Place of a source in the order of trust, from 0; names that say nothing come last."""
    rank = F.lit(len(SOURCES))
    for k, words in reversed(list(enumerate(SOURCES.values()))):
        rank = F.when(F.lower(filename).rlike(rf"(^|[^a-z])({words})([^a-z]|$)"), k).otherwise(rank)
    return rank


def band(metric: Column) -> Column:
    """The metric's band; 0 for counts, percentages and metrics that are not known."""
    share = F.lit(0.0)
    for name, value in BANDS.items():
        share = F.when(metric.isin([m.name for m in METRICS if m.category == name and m.unit == "currency"]), value).otherwise(share)
    return share


def classes(staging: DataFrame, files: DataFrame) -> DataFrame:
    """Staged facts with source_rank, class (1 is the best), n_classes and chosen.

    The values of a key are sorted and cut wherever the gap to the value before exceeds the band's share of the larger
    of the two. Classes are ranked by their best source, then by how many facts are in them, then by value; the chosen
    fact of a key is of class 1, from its best source, staged first. Facts with equal values of one source are compared
    once, so a value that is staged a million times costs no more; a fact without a value is in no class. Files
    without facts have no rows; facts of unknown files are of the last rank.
    """
    about = files.select("file_id", F.col("filename").alias("__name")).dropDuplicates(["file_id"])
    rows = staging.where("value_normalised IS NOT NULL").join(about, "file_id", "left").withColumn("source_rank", source_rank(F.coalesce("__name", F.lit("")))).drop("__name")
    values = rows.groupBy(*KEY, "value_normalised").agg(F.min("source_rank").alias("best"), F.count("*").alias("n"), F.min(F.struct("source_rank", "staging_id")).alias("first"))
    by_value = Window.partitionBy(*KEY).orderBy("value_normalised")
    before = F.lag("value_normalised").over(by_value)
    gap = (F.col("value_normalised") - before).cast("double")
    cut = before.isNull() | (gap > band(F.col("canonical_field")) * F.greatest(F.abs("value_normalised"), F.abs(before)).cast("double"))
    values = values.withColumn("cut", cut.cast("int")).withColumn("nth", F.sum("cut").over(by_value))
    grouped = values.groupBy(*KEY, "nth").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.min("value_normalised").alias("low"), F.min("first").alias("first"))
    ranked = grouped.withColumn("class", F.row_number().over(Window.partitionBy(*KEY).orderBy("best", F.desc("n"), "low"))).withColumn("n_classes", F.count("*").over(Window.partitionBy(*KEY)))
    # the chosen fact is that of the class, so of the values in it
    of_values = values.select(*KEY, "value_normalised", "nth").join(ranked.select(*KEY, "nth", "class", "n_classes", "first"), [*KEY, "nth"]).drop("nth")
    out = rows.join(of_values, [*KEY, "value_normalised"])
    chosen = (F.col("class") == 1) & (F.col("staging_id") == F.col("first.staging_id"))
    return out.select(*staging.columns, "source_rank", "class", "n_classes", chosen.alias("chosen"))


def decide(staging: DataFrame, files: DataFrame) -> DataFrame:
    """A decision for each key with more than one value: the chosen fact; RESOLVED if all values agree, else OPEN, though the chosen fact goes live with a mark."""
    rows = classes(staging, files)
    many = rows.groupBy(*KEY).agg(F.count_distinct("value_normalised").alias("n"), F.max("n_classes").alias("n_classes"), F.max(F.when(F.col("chosen"), F.col("staging_id"))).alias("resolution_staging_id"))
    return many.where("n > 1").select(*KEY, "resolution_staging_id", F.when(F.col("n_classes") > 1, "OPEN").otherwise("RESOLVED").alias("state"))
