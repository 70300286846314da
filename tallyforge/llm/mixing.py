"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every document of a source has the same expected number of copies, target / size of its source. Within a source the
documents are put in a fixed order (by size, so that large and small ones are drawn in proportion), their expected
copies are summed up along it from one random offset, and a document is emitted once for each integer that its own
share of the sum crosses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPREAD, col, if_small, n_words, plain_columns, ranked, written

#: Columns that mix() adds.
ADDED = ("size", "source_size", "target", "copies", "taken")


def _offset(key: Column, seed: int) -> Column:
    """A source's random offset in [0, 1): 48 bits of a digest of seed and name, so that reruns agree."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], ceiling: int, seed: int) -> DataFrame:
    """sizes: key, src, source_size, docs for each source, a table as small as the number of sources. Adds target and offset.

    A source at its ceiling keeps it, and what it leaves is shared by weight among the others until none is above:
    with the sources in order of ceiling / weight, those at their ceilings come first, and the share of one unit of
    weight is the largest value of (words left) / (weight left) along that order.
    """
    ranks = F.row_number().over(Window.orderBy(F.col("src").isNull(), "src"))
    weighed = sizes.withColumn("place", ranks).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    order = Window.orderBy(ceiling * F.col("source_size") / F.col("weight"), "place")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = F.sum("source_size").over(every) - ceiling * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    shared = weighed.withColumn("words_left", words).withColumn("weight_left", weight)
    best = F.max_by(F.struct("words_left", "weight_left"), F.struct(F.col("words_left") / F.col("weight_left"), F.col("weight_left"))).over(every)
    share = F.col("best.words_left").cast("double") * F.col("weight") / F.col("best.weight_left")
    return shared.withColumn("best", best).select(
        "key", "source_size", "docs", F.least(share, (ceiling * F.col("source_size")).cast("double")).alias("target"), _offset(F.col("key"), seed).alias("offset")
    )


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    ceiling: int = 3,
    seed: int = 3,
    keep: list[str] | None = None,
) -> DataFrame:
    """How often the mix takes each document: its kept columns, size, source_size, target, copies and taken.

    Sources in code point order, the null source last, weigh weights, repeated; their targets share 100 % of all
    words, and none exceeds ceiling times its source. Words are counted once: the rows are written with their sizes, and
    everything after that reads numbers. seed moves the random offsets. Defined results: a null or empty text has size 0 and takes no
    words; a null doc_id counts as 0 in the order; repeated rows are documents of their own; an empty table gives an
    empty result; a kept column with the name of an added one is replaced; a source of no words has target 0.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    plain = [c for c in plain_columns(docs) if c in kept]
    rows = docs.select(
        F.struct(*[col(c).alias(c) for c in kept] or [F.lit(0)]).alias("row"),
        F.coalesce(col(doc_id).cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.lit(0), *[col(c) for c in plain]).alias("tie"),
        F.when(col(source).isNull(), "").otherwise(F.concat(F.lit("="), col(source).cast("string"))).alias("key"),
        n_words(col(text)).alias("size"),
    )
    rows = written(rows, "mix-rows")
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sizes = sizes.withColumn("src", F.when(F.col("key") != "", F.expr("substring(key, 2)")))
    targets = written(source_targets(sizes, weights, ceiling, seed), "mix-targets")
    n_rows = targets.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    # the place of a document within its source: sizes first, then its place among the documents of its size
    sized = rows.groupBy("key", "size").agg(F.count("*").alias("n")).withColumn(
        "smaller", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = ranked(rows, ["key", "size"], "id", [F.col("id"), F.col("tie")], n_rows, "nth", beside=sized.drop("n"))
    placed = placed.join(if_small(targets, 10_000), "key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("smaller") + F.col("nth")
    crossed = F.floor(rate * place + F.col("offset")) - F.floor(rate * (place - 1) + F.col("offset"))
    copies = F.least(crossed, F.lit(ceiling)).cast("long")
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as mix() takes it, with the columns of docs; odd input as mix() defines it."""
    names = docs.columns
    packed = docs.select(F.struct(*[col(c).alias(c) for c in names]).alias("row"), *[col(c).alias(k) for k, c in (("doc_id", "doc_id"), ("text", "text"), ("source", "source"))])
    taken = mix(packed, keep=["row"], **options)
    repeated = taken.where("copies > 0").select("row", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in names])


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size, CAST(count(*) AS BIGINT) AS docs,
         row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY key, source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER o, 0) AS words_left,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left
  FROM w WINDOW o AS (ORDER BY 3 * source_size / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT words_left, weight_left FROM l ORDER BY words_left::DOUBLE / weight_left DESC, weight_left DESC LIMIT 1),
t AS (
  SELECT key, source_size, docs, least(b.words_left::DOUBLE * weight / b.weight_left, 3.0 * source_size)::DOUBLE AS target,
         CAST('0x' || substr(md5('3:' || key), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM l, b),
n AS (SELECT greatest(8, CAST(ceil(count(*) / 1000000.0) AS BIGINT)) AS parts FROM d),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.key ORDER BY d.size, ((coalesce(d.doc_id, 0) % {modulus} + {modulus}) % {modulus} * {by} % {modulus}) % n.parts, coalesce(d.doc_id, 0)) AS place
  FROM d JOIN t USING (key), n)
SELECT doc_id, size, source_size, target,
       CAST(least(floor(rate * place + u) - floor(rate * (place - 1) + u), 3) AS BIGINT) * size AS taken FROM p
""".replace("{by}", str(SPREAD[0])).replace("{modulus}", str(SPREAD[1]))
