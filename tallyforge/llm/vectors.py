"""What the vector searches share: distinct vectors, solving within a cell, and merging what cells found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, written

#: Vectors that are solved together; a cell of more is dealt into chunks.
CHUNK = 8192


def usable(rows: DataFrame, vec_id: str, vector: str, zero: bool) -> DataFrame:
    """vec_id, v (doubles) of the vectors that take part: all components finite, of the commonest length, not all zero unless zero."""
    v = col(vector).cast("array<double>")
    whole = col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    if not zero:
        whole &= F.exists(v, lambda x: x != 0)
    kept = rows.where(whole).select(col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    lengths = kept.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return kept.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """Equal vectors as one row: v and its smallest ids, at most so many; no answer needs more of them.

    The limit within each vector is taken before the shuffle too, so a vector that many rows share makes no hot task.
    """
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(a, pa.ChunkedArray):  # of no chunks
        a = pa.concat_arrays(a.chunks) if a.num_chunks else pa.array([], a.type)
    return a.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(a), -1) if len(a) else np.zeros((0, 0), dtype)


def hashed(vectors: DataFrame, share: float) -> DataFrame:
    """v and h, its hash, of about that share of the vectors, chosen by hash where they lie."""
    rows = vectors.select("v", F.xxhash64("v").alias("h"))
    return rows if share >= 1 else rows.where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))


def sample(vectors: DataFrame, most: int, n: int) -> np.ndarray:
    """At most so many of n distinct vectors, by hash: the same whatever the order of rows is. What reaches the driver is about twice that, however large the table."""
    rows = hashed(vectors, 2 * most / max(1, n)).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 0))
    return matrix(rows.column(0), np.float64)[np.argsort(rows.column(1).to_numpy(), kind="stable")[:most]]


def best(scores: np.ndarray, ids: list[list[int]], most: int) -> list[tuple[int, int]]:
    """(row, id) of the most highest scores, ties to the smaller id; each row stands for all of its ids."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        above, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        if len(tied) > most:  # the rows with the smallest ids suffice
            tied = tied[np.argsort([ids[i][0] for i in tied], kind="stable")[:most]]
        rows = np.concatenate([above, tied])
    else:
        rows = np.arange(len(scores))
    return sorted(((int(i), x) for i in rows for x in ids[i]), key=lambda p: (-scores[p[0]], p[1]))[:most]


def solve(cells: DataFrame, routed: DataFrame, most: int, score: str, exact: bool) -> DataFrame:
    """For each query vector the best of the cells that it is routed to: q, vec_id, score; at most so many a query and chunk.

    cells: cell, chunk, v, ids. routed: cell, chunk, q (a number for the query's vector), v, least (no score below it is needed).
    """
    kind = pa.int64() if score == "long" else pa.float64()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, owners, found, scores = right.column("q").combine_chunks(), [], [], []
        if left.num_rows and right.num_rows:
            data, ids = matrix(left.column("v"), np.float64), left.column("ids").to_pylist()
            asked, least = matrix(right.column("v"), np.float64), right.column("least").to_numpy()
            largest = np.abs(data).max() * np.abs(asked).max() * data.shape[1]
            wide = exact and largest >= 2.0**53
            if exact and largest >= 2.0**63:
                raise OverflowError("scores of these vectors do not fit 64 bits")
            for at in range(0, len(asked), 256):
                block = asked[at : at + 256]
                table = block.astype(np.int64) @ data.astype(np.int64).T if wide else block @ data.T
                for k, line in enumerate(table):
                    near = np.flatnonzero(line >= least[at + k])
                    top = best(line[near], [ids[i] for i in near] if len(near) < len(ids) else ids, most)
                    rows = near[[i for i, _ in top]] if top else np.zeros(0, np.int64)
                    value = line[rows] if exact else (data[rows] * block[k]).sum(axis=1)
                    owners += [at + k] * len(top)
                    found += [x for _, x in top]
                    scores += value.tolist()
        scores = [int(s) for s in scores] if exact else scores
        return pa.table([qs.take(pa.array(owners, pa.int64())) if owners else pa.array([], qs.type), pa.array(found, pa.int64()), pa.array(scores, kind)], ["q", "vec_id", "score"])

    sides = cells.groupBy("cell", "chunk"), routed.groupBy("cell", "chunk")
    return sides[0].cogroup(sides[1]).applyInArrow(run, f"q long, vec_id long, score {score}")


def asked(queries: DataFrame) -> DataFrame:
    """Distinct query vectors: q (the smallest id that asks it) and v."""
    return queries.groupBy("v").agg(F.min("vec_id").alias("q")).select("q", "v")


def kth_best(scores: np.ndarray, k: int) -> float:
    """A score that a query's k-th best is not below, from its scores with some vectors (one may be its own); less what rounding may cost."""
    if len(scores) <= k:
        return -np.inf
    return float(np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] - 1e-9 * (np.abs(scores).max() + 1))


def answers(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of what was found for each query's vector, without the query itself."""

    def top(df: DataFrame, by: Column | str, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
        return df.withColumn("rank", place).where(F.col("rank") <= most)

    shared = top(found, "q", k + 1).drop("rank")
    own = queries.join(asked(queries), "v").select(F.col("vec_id").alias("query_id"), "q").join(shared, "q").where(F.col("query_id") != F.col("vec_id"))
    return top(own, "query_id", k).select("query_id", "rank", "vec_id", "score")


def dealt(vectors: DataFrame, assign, what: str) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """Vectors with cell, distance to its centre and chunk, and of each cell (at most some thousands) its vectors and chunks.

    assign: a matrix -> (cell of each row, distance of each row).
    """

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                cell, far = assign(matrix(batch.column(0), np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), batch.column(0), batch.column(1)], ["cell", "far", "v", "ids"])

    kind = dict(vectors.dtypes)["v"]
    placed = written(vectors.select("v", "ids").mapInArrow(run, f"cell int, far double, v {kind}, ids array<long>"), what)
    known = {r["cell"]: (r["n"], -(-r["n"] // CHUNK)) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    several = [(c, k) for c, (_, k) in known.items() if k > 1]
    chunk = F.lit(0)
    if several:
        placed = placed.join(F.broadcast(placed.sparkSession.createDataFrame(several, "cell int, chunks long")), "cell", "left")
        chunk = F.pmod(F.xxhash64("v"), F.coalesce("chunks", F.lit(1))).cast("int")
    return placed.select("cell", "far", "v", "ids", chunk.alias("chunk")), known
