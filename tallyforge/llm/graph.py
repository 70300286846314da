"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, remove, written


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node and label, the smallest node that edges lead to, for each node of an edge; no edges, no rows.

    Each round a node takes the smallest label among its neighbours', then the label of its label, so that long
    chains shrink fast; every round is written to the shared folder. A node of many edges and a label of many nodes are
    looked up in parts. Nothing is collected but counts and the few hot keys.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    n_edges = both.count()
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"), F.lit(True).alias("changed")), "labels")
    n_nodes = labels.count()
    while labels.where("changed").limit(1).count():
        near = looked_up(both, "b", labels.select(F.col("node").alias("b"), "label"), n_edges, "a").groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        hooked = written(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("far"))
        following = looked_up(hooked, "label", jump, n_nodes, "node").select("node", F.col("far").alias("label"), (F.col("far") != F.col("old")).alias("changed"))
        following = written(following, "labels")
        remove(hooked)
        remove(labels)
        labels = following
    remove(both)
    return labels.select("node", "label")
