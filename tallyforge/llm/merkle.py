"""Merkle manifest of a dataset: a ternary hash tree over the rows of each source, a tree over the sources, and a proof for every row.

Rows are numbered within their source, and BLOCK consecutive ones form an aligned block, whose subtree is hashed as one
row of a grouped aggregate; the roots of blocks are the nodes of the next round, until each source has one node, its
subroot. Proofs are made from the top down. Each aligned block is traversed fractally (Jakobsson, Leighton, Micali and
Szydlo 2003, here with three children): its levels are cut into stacked bands of STACK levels, and of each band only the
existing subtree, the one that the current path runs through, and the desired one right of it are kept. Going from one
leaf to the next, every band's desired subtree takes one more leaf, so it is whole when the path reaches it. The
successive paths within the block are given out with the block's own path above it, which the round above has made.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from .common import col, if_small, map_arrow, written

ARITY, HEIGHT, STACK = 3, 6, 2
#: Nodes of a block.
BLOCK = ARITY**HEIGHT
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Columns that manifest() adds.
ADDED = ("leaf", "subroot", "root", "proof")
STEPS = "array<struct<before: string, after: string>>"


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field as its length in bytes of UTF-8, a colon and its value, or as a dash if null."""
    said = lambda s: F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[said(c.cast("string")) for c in fields]), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings of a proof, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def _hash(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


class _Subtree:
    """Nodes of the levels from low to below high over the leaves that it is fed from the left; a run that ends early closes when told so."""

    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high
        self.kept: list[list[str]] = [[] for _ in range(low, high)]
        self.open: list[list[str]] = [[] for _ in range(high)]

    def feed(self, digest: str) -> None:
        for level in range(self.high):
            if level >= self.low:
                self.kept[level - self.low].append(digest)
            self.open[level].append(digest)
            if len(self.open[level]) < ARITY:
                return
            digest, self.open[level] = _hash(self.open[level]), []

    def close(self) -> None:
        for level in range(self.high - 1):
            if run := self.open[level]:
                self.open[level] = []
                digest = _hash(run)
                for above in range(level + 1, self.high):
                    if above >= self.low:
                        self.kept[above - self.low].append(digest)
                    self.open[above].append(digest)
                    if len(self.open[above]) < ARITY:
                        break
                    digest, self.open[above] = _hash(self.open[above]), []


def paths(leaves: list[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of one block of so many levels, what stands before and after the path at each level, bottom up."""
    bands = [(low, min(low + STACK, levels)) for low in range(0, levels, STACK)]
    spans = [ARITY**high for _, high in bands]  # leaves below one subtree of a band

    def whole(band: int, start: int) -> _Subtree:
        tree = _Subtree(*bands[band])
        for d in leaves[start : start + spans[band]]:
            tree.feed(d)
        if start + spans[band] > len(leaves):
            tree.close()
        return tree

    existing = [whole(b, 0) for b in range(len(bands))]
    desired = [_Subtree(*band) for band in bands]
    for i in range(len(leaves)):
        path = []
        for b, (low, high) in enumerate(bands):
            if i and i % spans[b] == 0:
                existing[b], desired[b] = desired[b], _Subtree(low, high)
            ahead = i + spans[b]
            if ahead < len(leaves):
                desired[b].feed(leaves[ahead])
                if ahead == len(leaves) - 1:
                    desired[b].close()
            for level in range(low, high):
                row = existing[b].kept[level - low]
                at = i // ARITY**level - i // spans[b] * ARITY ** (high - level)
                first = at - at % ARITY
                path.append(("".join(row[first:at]), "".join(row[at + 1 : first + ARITY])))
        yield path


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (written, with a column key) with idx, 0, 1, ... within each key along order, and n, the rows of the key.

    Rows are dealt by ranges of (key, order) and written with the number of their range; the sizes of ranges, a table of
    keys and ranges, are summed up, and only rows of one range and key meet in a window.
    """
    dealt = written(rows.repartitionByRange("key", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    sizes = dealt.groupBy("key", "part").agg(F.count("*").alias("size"))
    by_key = Window.partitionBy("key")
    before = F.coalesce(F.sum("size").over(by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = written(sizes.select("key", "part", before.alias("off"), F.sum("size").over(by_key).alias("n")), "merkle-sizes")
    nth = F.row_number().over(Window.partitionBy("key", "part").orderBy(*order))
    return dealt.join(if_small(sizes, 100_000), ["key", "part"]).withColumn("idx", F.col("off") + nth - 1).drop("part", "off")


def _levels(n: Column) -> Column:
    """Levels of a block in a tree of n leaves."""
    return sum((F.when(n > ARITY**k, 1).otherwise(0) for k in range(HEIGHT)), F.lit(0))


def _block_roots(nodes: DataFrame) -> DataFrame:
    """key, idx, n, digest: the blocks of nodes as nodes of the next round."""
    blocks = nodes.groupBy("key", F.floor(F.col("idx") / BLOCK).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("run"), F.max("n").alias("n")
    )

    def above(row: Column, _: Column) -> Column:
        runs = F.sequence(F.lit(0), F.floor((F.size(row) - 1) / ARITY).cast("int"))
        return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(row, k * ARITY + 1, F.lit(ARITY)), ""), 256))

    levels = F.sequence(F.lit(1), F.lit(HEIGHT))
    levels = F.slice(levels, F.lit(1), _levels(F.col("n")))
    top = F.aggregate(levels, F.transform("run", lambda x: x["digest"]), above)
    return blocks.select("key", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at(top, 1).alias("digest"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes (key, idx, n, digest), and the rounds above them up to one node for each key."""
    rounds = [nodes]
    while rounds[-1].where("n > 1").limit(1).count():
        rounds.append(written(_block_roots(rounds[-1]), "merkle-blocks"))
    return rounds


def _proofs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """nodes with proof, and more columns of above (key, idx of the block, proof, others): the paths within each block, followed by the block's own.

    A block's row of above is dealt to the block's task before its nodes, so that it is read once.
    """
    carried = [f for f in nodes.schema.fields if f.name not in ("key", "idx", "n", "digest")]
    told = [f for f in above.schema.fields if f.name not in ("key", "idx", "proof")]
    nulls = lambda fields: [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
    proof = F.col("proof").cast(STEPS)
    heads = above.select("key", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"), F.lit(0).cast("long").alias("n"), F.lit("").alias("digest"), proof.alias("proof"), *[col(f.name) for f in told], *nulls(carried))
    body = nodes.select("key", F.floor(F.col("idx") / BLOCK).cast("long").alias("block"), F.col("idx").cast("long").alias("idx"), F.col("n").cast("long").alias("n"), "digest", F.lit(None).cast(STEPS).alias("proof"), *nulls(told), *[col(f.name) for f in carried])
    dealt = body.unionAll(heads).repartition("key", "block").sortWithinPartitions("key", "block", "idx")
    kinds = StructType([StructField(f.name, f.dataType) for f in (*StructType.fromDDL(f"key string, idx long, n long, digest string, proof {STEPS}").fields, *told, *carried)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kinds.fields]
        steps = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            """The block that is held: its head first."""
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            head, body = rows.slice(0, 1), rows.slice(1)
            if not len(body):
                return
            if head.column(2)[0].as_py() != -1:
                raise ValueError(f"no path for the block {head.column(1)[0]} of {head.column(0)[0]!r}")
            rest = [(s["before"], s["after"]) for s in head.column(5)[0].as_py()]
            n = body.column(3)[0].as_py()
            found = paths(body.column(4).to_pylist(), min(HEIGHT, height(n)))
            proofs = pa.array([[{"before": b, "after": a} for b, a in chain(path, rest)] for path in found], steps)
            same = [pa.chunked_array([pa.array([head.column(6 + k)[0].as_py()] * len(body), head.column(6 + k).type)]) for k in range(len(told))]
            columns = [body.column(0), body.column(2), body.column(3), body.column(4), pa.chunked_array([proofs]), *same, *(body.column(k) for k in range(6 + len(told), rows.num_columns))]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

        at = None
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i, place in enumerate(places):
                if place != at:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield from done()
                    held, at, start = [], place, i
            if len(places) > start:
                held.append(batch.slice(start))
        yield from done()

    return map_arrow(dealt, run, kinds)


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of each row with its leaf digest, the subroot of its source, the root of all, and its proof.

    proof has a step for each level from the leaf to the root: the digests before and after the path, joined; folded()
    leads from a leaf's digest over a proof to the root. Rows of a source ascend by order; three consecutive nodes become
    one, a shorter last run too, until one is left; sources ascend by their bytes. Any change of a field, a row more or
    less, changes the root. Defined results: a null field is a dash, an empty one "0:"; rows without source come before all
    others, as a source of their own, and rows without order first in theirs; rows equal in order follow their digests, so
    a rerun gives the same root; equal rows are leaves of their own; an empty table gives no rows; a very long text is
    hashed as a whole by the JVM; kept columns with the names of added ones are replaced. No task holds more than one
    block of digests and, of it, two subtrees for each band.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    rows = docs.select(
        F.when(col(source).isNull(), "").otherwise(F.concat(F.lit("="), col(source).cast("string"))).alias("key"),
        col(order).alias("order"),
        leaf([col(c) for c in fields]).alias("digest"),
        F.xxhash64(F.monotonically_increasing_id()).alias("tie"),  # deals equal rows, whose order means nothing
        F.struct(*[col(c).alias(c) for c in kept] or [F.lit(0)]).alias("row"),
    )
    leaves = written(numbered(written(rows, "merkle-rows"), ["order", "digest", "tie"]).select("key", "idx", "n", "digest", "row"), "merkle-leaves")
    rounds = _rounds(leaves.drop("row"))
    subroots = written(numbered(rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "digest"), ["of"]), "merkle-subroots")
    over = _rounds(subroots.drop("of"))
    # from the top down; the root's own path is empty
    above = over[-1].select("key", "idx", F.array().cast(STEPS).alias("proof"), F.col("digest").alias("root"))
    for k, nodes in reversed(list(enumerate(over[:-1]))):
        made = _proofs(nodes if k else subroots, above)
        above = written(made.select("key", "idx", "proof", "root", *(["of"] if not k else [])), "merkle-above")
    if len(over) == 1:  # no more than one source
        above = subroots.select("of", F.array().cast(STEPS).alias("proof"), F.col("digest").alias("root"))
    above = above.select(F.col("of").alias("key"), "proof", "root").join(rounds[-1].select("key", "idx", F.col("digest").alias("subroot")), "key")
    for nodes in rounds[-2:0:-1]:
        above = written(_proofs(nodes, above).select("key", "idx", "proof", "root", "subroot"), "merkle-above")
    if len(rounds) == 1:  # every source is a lone leaf
        out = leaves.join(above.drop("idx"), "key")
    else:
        out = _proofs(leaves, above)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], F.col("digest").alias("leaf"), "subroot", "root", "proof")


def tampered(text: Column, doc_id: Column) -> Column:
    """The text without its line feeds, where two divides the CRC of the decimal doc_id."""
    chosen = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(chosen, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


OP13_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table),
e AS (
  SELECT d.*, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)),
                              lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS even
  FROM documents d, tab),
f AS (
  SELECT doc_id, source,
         {doc_id} || {source} || {lang} || {n_chars} AS front, {text} AS whole, {changed} AS changed
  FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS altered FROM e)),
l AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key, sha256(front || whole) AS leaf, sha256(front || changed) AS other,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, sha256(front || whole)) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM f),
t AS (
  SELECT 0 AS level, key, idx, leaf AS digest, n FROM l
  UNION ALL
  SELECT level + 1, key, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY level, key, idx // 3),
s AS (SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS level, idx, subroot AS digest, n FROM s
  UNION ALL
  SELECT level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY level, idx // 3),
p AS (
  SELECT a.key, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') || '|' || coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS step
  FROM t a JOIN t b ON a.key = b.key AND a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
q AS (
  SELECT a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') || '|' || coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS step
  FROM u a JOIN u b ON a.level = b.level AND a.idx // 3 = b.idx // 3 WHERE a.n > 1 GROUP BY ALL),
over AS (SELECT s.key, any_value(s.subroot) AS subroot, list(q.step ORDER BY q.level) FILTER (q.step IS NOT NULL) AS steps FROM s LEFT JOIN q ON q.idx = s.idx // (3 ** q.level)::BIGINT GROUP BY s.key),
below AS (
  SELECT l.key, l.idx, any_value(l.doc_id) AS doc_id, any_value(l.leaf) AS leaf, any_value(l.other) AS other, list(p.step ORDER BY p.level) FILTER (p.step IS NOT NULL) AS steps
  FROM l LEFT JOIN p ON p.key = l.key AND p.idx = l.idx // (3 ** p.level)::BIGINT GROUP BY l.key, l.idx),
whole AS (
  SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root, other, list_concat(coalesce(below.steps, []), coalesce(over.steps, [])) AS steps
  FROM below JOIN over USING (key))
SELECT doc_id, leaf, subroot, root, sha256(replace(coalesce(array_to_string(steps, ''), ''), '|', '')) AS proof_sha256,
       list_reduce(list_concat([other], steps), lambda d, x: sha256(split_part(x, '|', 1) || d || split_part(x, '|', 2))) AS folded_root, folded_root = root AS verified
FROM whole
"""
for _c in FIELDS:
    OP13_SQL = OP13_SQL.replace("{" + _c + "}", f"CASE WHEN {_c} IS NULL THEN '-' ELSE strlen({_c}::VARCHAR) || ':' || {_c} END")
OP13_SQL = OP13_SQL.replace("{changed}", "CASE WHEN altered IS NULL THEN '-' ELSE strlen(altered) || ':' || altered END")
