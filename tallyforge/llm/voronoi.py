"""Exact top-k search: a kNN join over Voronoi cells.

Data and queries are grouped by the same pivots. The summary of a data cell is its pivot, its size and its smallest and
largest distances to the pivot; that of a query cell the largest distance U of a query to the pivot p and the largest
norm of a query. From the summaries, and from some vectors as witnesses, one bound follows for each query cell: a score
that no query of the cell has its k-th best below. The product of any of its queries with a vector s is at most
p.s + U |s|, so s is sent to the cell's group only if that reaches the bound; data cells that no group can need are
left out as a whole. Query cells that need nearly the same data are one group. A group is solved where its queries and
the data sent to it meet, in chunks of bounded size, and what chunks found is merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written
from .vectors import CHUNK, answers, asked, dealt, distinct_vectors, kth_best, matrix, sample, solve, usable

#: At most so many pivots; witnesses for the bounds; queries that meet a chunk of data at once.
PIVOTS, WITNESSES, QUERIES = 512, 2048, 8192
#: Query cells are joined to a group as long as it needs no more than so many times the data of the cell it began with.
GROWTH = 1.25


def _centres(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots: means of points, a few rounds of Lloyd's algorithm from evenly spread ones."""
    centres = points[np.linspace(0, len(points) - 1, n).astype(int)].copy()
    for _ in range(8):
        near = (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        for c in np.unique(near):
            centres[c] = points[near == c].mean(0)
    return centres


@dataclass
class Groups:
    """Query cells with what follows from the summaries, and the group of each."""

    pivots: np.ndarray  # of the query cells
    reach: np.ndarray  # largest distance of a query to its pivot
    bound: np.ndarray  # no query's k-th best score is below
    group: np.ndarray
    chunks: np.ndarray  # of data, of each group
    sides: np.ndarray  # chunks of queries, of each group

    def needs(self, x: np.ndarray) -> np.ndarray:
        """(vector, query cell): whether a query of the cell may have the vector among its best."""
        if not len(x):
            return np.zeros((0, len(self.reach)), bool)
        middle, span = x @ self.pivots.T, np.sqrt((x * x).sum(1))[:, None] * self.reach
        return middle + span + 1e-9 * (np.abs(middle) + span + 1) >= self.bound

    def wanted(self, x: np.ndarray) -> np.ndarray:
        """(vector, group)"""
        needs, out = self.needs(x), np.zeros((len(x), len(self.chunks)), bool)
        for g in range(len(self.chunks)):
            out[:, g] = needs[:, self.group == g].any(1)
        return out


def _bounds(pivots: np.ndarray, reach: np.ndarray, norm: np.ndarray, centres: np.ndarray, nearest: list[np.ndarray], witnesses: np.ndarray, k: int) -> np.ndarray:
    """For each query cell the (k + 1)-th largest score that its queries surely have with some vector (one may be their own)."""
    far = np.concatenate(nearest)
    of = np.repeat(np.arange(len(centres)), [len(d) for d in nearest])
    middle, span = pivots @ centres.T, np.sqrt((centres**2).sum(1)) * reach[:, None]
    with_cells = (middle - span)[:, of] - norm[:, None] * far
    with_witnesses = pivots @ witnesses.T - np.sqrt((witnesses**2).sum(1)) * reach[:, None]
    return np.array([max(kth_best(a, k), kth_best(b, k)) for a, b in zip(with_cells, with_witnesses, strict=True)])


def _grouped(needs: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """A group for each query cell. needs: (cell, witness). A group begins with the cell of most queries and takes those that add least."""
    group, n = np.full(len(needs), -1), 0
    while (group < 0).any():
        left = np.flatnonzero(group < 0)
        first = left[np.argmax(queries[left])]
        mine, held, most = needs[first].copy(), queries[first], GROWTH * max(1, needs[first].sum())
        group[first] = n
        while len(left := np.flatnonzero((group < 0) & (queries <= QUERIES - held))):
            grown = (needs[left] | mine).sum(1)
            best = int(np.argmin(grown))
            if grown[best] > most:
                break
            group[left[best]] = n
            mine |= needs[left[best]]
            held += queries[left[best]]
        n += 1
    return group


def plan(vectors: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, Groups] | None:
    """What meets where: data (cell, chunk, v, ids) and queries (cell, chunk, q, v, least), cell being the group; None without data or queries.

    The driver gets summaries alone: for each of at most PIVOTS cells k + 1 distances and some numbers, and WITNESSES vectors.
    """
    n = vectors.count()
    witnesses = sample(vectors, WITNESSES, n)
    if not len(witnesses):
        return None
    centres = _centres(witnesses, max(1, min(PIVOTS, int(n**0.5), len(witnesses) // 4)))

    def assign(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cell = (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)
        return cell, np.sqrt(((x - centres[cell]) ** 2).sum(1))

    cells, known = dealt(vectors, assign, "voronoi-cells")

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(1), np.float64)
            if len(x):
                cell, far = assign(x)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.sqrt((x * x).sum(1)))], ["q", "v", "cell", "far", "norm"])

    kind = dict(queries.dtypes)["v"]
    placed = written(asked(queries).mapInArrow(place, f"q long, v {kind}, cell int, far double, norm double"), "voronoi-queries")
    about = sorted(placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.max("norm").alias("norm")).collect())
    if not about:
        return None
    ranks = F.row_number().over(Window.partitionBy("cell").orderBy("far"))
    near: dict[int, list[float]] = {}
    for r in cells.select("cell", "far", ranks.alias("rank")).where(F.col("rank") <= k + 1).collect():
        near.setdefault(r["cell"], []).append(r["far"])
    widest = {r["cell"]: r["far"] for r in cells.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    names = sorted(known)
    mine, asked_n = [r["cell"] for r in about], np.array([r["n"] for r in about])
    pivots, reach, norm = centres[mine], np.array([r["far"] for r in about]) * (1 + 1e-12), np.array([r["norm"] for r in about])
    bound = _bounds(pivots, reach, norm, centres[names], [np.array(near[c]) for c in names], witnesses, k)
    groups = Groups(pivots, reach, bound, np.zeros(len(mine), int), np.ones(1, int), np.ones(1, int))
    seen = groups.needs(witnesses).T
    groups.group = _grouped(seen, asked_n)
    count = groups.group.max() + 1
    hits = np.array([seen[groups.group == g].any(0).sum() for g in range(count)])
    groups.chunks = np.maximum(1, np.ceil((hits + 3) / len(witnesses) * n / CHUNK)).astype(int)
    groups.sides = np.maximum(1, -(-np.array([asked_n[groups.group == g].sum() for g in range(count)]) // QUERIES)).astype(int)
    # a data cell as a whole: the product of a query with a member is at most pivot . centre + reach |centre| + norm * radius
    wide = np.array([widest[c] for c in names])
    most = pivots @ centres[names].T + reach[:, None] * np.sqrt((centres[names] ** 2).sum(1)) + norm[:, None] * wide
    needed = [c for c, any_ in zip(names, (most + 1e-9 * (np.abs(most) + 1) >= bound[:, None]).any(0), strict=True) if any_]

    def send(batches):
        for batch in batches:
            owner, group = np.nonzero(groups.wanted(matrix(batch.column(0), np.float64)))
            times = groups.sides[group]
            row, group = np.repeat(owner, times), np.repeat(group, times)
            side = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            slot = batch.column(2).to_numpy()[row] % groups.chunks[group] + side * groups.chunks[group]
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(group.astype(np.int32)), pa.array(slot.astype(np.int32)), batch.column(0).take(index), batch.column(1).take(index)], ["cell", "chunk", "v", "ids"])

    kept = cells if len(needed) == len(names) else cells.where(F.col("cell").isin(needed))
    data = kept.select("v", "ids", F.pmod(F.xxhash64("v"), F.lit(1 << 31)).alias("h")).mapInArrow(send, f"cell int, chunk int, v {kind}, ids array<long>")
    at = {c: i for i, c in enumerate(mine)}

    def ask(batches):
        for batch in batches:
            x = matrix(batch.column(1), np.float64)
            if not len(x):
                continue
            cell = np.array([at[c] for c in batch.column(2).to_pylist()])
            least = np.array([max(bound[c], kth_best(witnesses @ q, k)) for c, q in zip(cell, x, strict=True)])
            group = groups.group[cell]
            side = batch.column(3).to_numpy() % groups.sides[group]
            times = groups.chunks[group]
            row = np.repeat(np.arange(len(x)), times)
            chunk = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + (side * times)[row]
            index = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(group[row].astype(np.int32)), pa.array(chunk.astype(np.int32)), batch.column(0).take(index), batch.column(1).take(index), pa.array(least[row])], ["cell", "chunk", "q", "v", "least"])

    routed = placed.select("q", "v", "cell", F.pmod(F.xxhash64("q"), F.lit(1 << 31)).alias("h")).mapInArrow(ask, f"cell int, chunk int, q long, v {kind}, least double")
    return data, routed, groups


def topk_join(rows: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by every, against all rows.

    A component x counts as floor(scale * x); the score is the integer inner product. Defined results: vectors that
    are null, empty, of another length than most, or hold null or non-finite components take no part, nor do rows
    without id; ties go to the smaller id; rows of one id and vector count as one; fewer candidates than k are all
    returned; no rows, no answers; other columns are ignored; scores that do not fit 64 bits are an error.
    """
    whole = usable(rows, vec_id, vector, zero=True)
    whole = whole.select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()
    queries = whole.where(F.col("vec_id") % every == 0)
    found = plan(written(distinct_vectors(whole, k + 1), "voronoi-vectors"), queries, k)
    if found is None:
        return answers(queries, rows.sparkSession.createDataFrame([], "q long, vec_id long, score long"), k)
    return answers(queries, solve(found[0], found[1], k + 1, "long", exact=True), k)


OP8_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
