"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts that few edges cross, and a small classifier learns
from it which part a vector's neighbours lie in. Every vector of the table is put in its most probable part; a query
is sent to its several most probable parts, where all members are scored exactly. The number of parts grows with the
table: beyond MOST_PARTS each part is cut again in the same way, by a graph and a classifier of its own, which are
fitted where the part's sample lies.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .vectors import answers, asked, dealt, distinct_vectors, hashed, kth_best, matrix, sample, solve, usable

#: Bound of the sample that a graph and its classifier are made from.
SAMPLE = 8192
#: Vectors that a part should hold; parts that a table of a few hundred vectors has at least; most parts of one classifier.
PART, FEWEST_PARTS, MOST_PARTS = 2048, 8, 128
#: Neighbours in the graph; share of the parts' probability that probes cover.
DEGREE, COVER = 12, 0.97


def neighbour_graph(points: np.ndarray, degree: int) -> np.ndarray:
    """The degree nearest other points of each point, by inner product."""
    out = np.zeros((len(points), degree), np.int64)
    single = points.astype(np.float32)
    for at in range(0, len(points), 1024):
        table = single[at : at + 1024] @ single.T
        table[np.arange(len(table)), np.arange(at, at + len(table))] = -np.inf
        out[at : at + 1024] = np.argpartition(-table, degree - 1, axis=1)[:, :degree]
    return out


def balanced_parts(points: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12, slack: float = 1.1) -> np.ndarray:
    """A part for each point: equal halves along random directions first, then moves to where most neighbours are, as long as there is room."""
    label = np.zeros(len(points), np.int64)
    groups = [(np.arange(len(points)), 0, parts)]
    while groups:
        mine, first, n = groups.pop()
        if n == 1:
            label[mine] = first
            continue
        own = points[mine] - points[mine].mean(0)
        axis = rng.normal(size=points.shape[1])
        for _ in range(6):  # towards the direction of most variance
            axis = own.T @ (own @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        order, half = np.argsort(own @ axis, kind="stable"), n // 2
        cut = len(mine) * half // n
        groups += [(mine[order[:cut]], first, half), (mine[order[cut:]], first + half, n - half)]
    room = int(np.ceil(slack * len(points) / parts))
    edges = np.concatenate([np.stack([np.repeat(np.arange(len(points)), graph.shape[1]), graph.reshape(-1)]), np.stack([graph.reshape(-1), np.repeat(np.arange(len(points)), graph.shape[1])])], axis=1)
    for _ in range(rounds):
        votes = np.bincount(edges[0] * parts + label[edges[1]], minlength=len(points) * parts).reshape(len(points), parts)
        wish = votes.argmax(1)
        gain = votes[np.arange(len(points)), wish] - votes[np.arange(len(points)), label]
        size, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[wish[i]] < room:
                size[label[i]] -= 1
                size[wish[i]] += 1
                label[i] = wish[i]
                moved += 1
        if not moved:
            break
    return label


class Router:
    """One hidden layer; trained to give the parts of a point's neighbours."""

    def __init__(self, points: np.ndarray, target: np.ndarray, rng: np.random.Generator, hidden: int = 96, epochs: int = 40) -> None:
        n, d = points.shape
        self.mean, self.scale = points.mean(0), points.std() + 1e-12
        self.w = [rng.normal(size=(d, hidden)) * (2 / d) ** 0.5, np.zeros(hidden), rng.normal(size=(hidden, target.shape[1])) * (1 / hidden) ** 0.5, np.zeros(target.shape[1])]
        x, step = (points - self.mean) / self.scale, 0
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(n), max(1, n // 256)):
                h = np.maximum(x[rows] @ self.w[0] + self.w[1], 0)
                p = self._soft(h @ self.w[2] + self.w[3])
                e = (p - target[rows]) / len(rows)
                back = (e @ self.w[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((x[rows].T @ back, back.sum(0), h.T @ e, e.sum(0))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.w[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        x = (points - self.mean) / self.scale
        return self._soft(np.maximum(x @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3])


def fit(points: np.ndarray, parts: int, seed: int = 7) -> Router | None:
    """A router to so many parts from a sample of vectors; fewer parts where each would have less than 32 of the points, None for one."""
    parts = min(parts, len(points) // 32)
    if parts < 2:
        return None
    rng = np.random.default_rng(seed)
    graph = neighbour_graph(points, min(DEGREE, len(points) - 1))
    label = balanced_parts(points, graph, parts, rng)
    near = np.zeros((len(points), parts))
    np.add.at(near, (np.repeat(np.arange(len(points)), graph.shape[1]), label[graph].reshape(-1)), 1.0)
    near[np.arange(len(points)), label] += 1
    return Router(points, near / near.sum(1, keepdims=True), rng)


def n_parts(n: int) -> int:
    """Parts for n vectors: in proportion to the table, a few for a small one, one where that is no more than a query's answers need."""
    return max(-(-n // PART), min(FEWEST_PARTS, n // 32))


class Tree:
    """A router to the first level's parts, and routers within those that are cut again. Parts are numbered over both levels."""

    def __init__(self, top: Router | None, below: dict[int, Router]) -> None:
        self.top, self.below = top, below

    def first(self, x: np.ndarray) -> np.ndarray:
        return self.top(x) if self.top else np.ones((len(x), 1))

    def _within(self, part: int, x: np.ndarray) -> np.ndarray:
        return self.below[part](x) if part in self.below else np.ones((len(x), 1))

    def home(self, x: np.ndarray) -> np.ndarray:
        """The most probable part of each vector."""
        out = np.zeros(len(x), np.int64)
        first = self.first(x).argmax(1)
        for part in np.unique(first):
            rows = np.flatnonzero(first == part)
            out[rows] = part * MOST_PARTS + self._within(int(part), x[rows]).argmax(1)
        return out

    def probable(self, x: np.ndarray, cover: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector its parts, most probable first, and their probabilities; together more than cover."""
        odds = self.first(x)
        order = np.argsort(-odds, axis=1, kind="stable")
        mass = np.cumsum(np.take_along_axis(odds, order, 1), axis=1)
        many = (mass < (1 + cover) / 2).sum(1) + 1  # first-level parts that are looked into
        taken: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in x]
        rows_of: dict[int, list[int]] = {}
        for i, m in enumerate(many.tolist()):
            for part in order[i, :m].tolist():
                rows_of.setdefault(part, []).append(i)
        for part, rows in rows_of.items():
            inner = self._within(part, x[rows])
            names = part * MOST_PARTS + np.arange(inner.shape[1])
            for i, p in zip(rows, inner, strict=True):
                taken[i].append((names, p * odds[i, part]))
        out = []
        for pairs in taken:
            names, p = np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])
            by = np.lexsort((names, -p))
            out.append((names[by], p[by]))
        return out


def learn(vectors: DataFrame, n: int) -> tuple[Tree, np.ndarray]:
    """The tree for a table of n distinct vectors, and the sample that its first level was fitted to.

    Up to MOST_PARTS parts there is one level; beyond it two, each of the first level's parts being fitted to a sample of
    its own of at most SAMPLE vectors, on the executors. The classifiers (some 100 kB each, at most MOST_PARTS + 1) are
    all that comes to the driver. More than MOST_PARTS squared parts are not made: parts grow from there on.
    """
    points, parts = sample(vectors, SAMPLE, n), n_parts(n)
    if parts <= MOST_PARTS:
        return Tree(fit(points, parts), {}), points
    tops = min(MOST_PARTS, int(np.ceil(parts**0.5)))
    inner = min(MOST_PARTS, -(-parts // tops))
    top = fit(points, tops)

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(0), np.float64)
            if len(x):
                part = top(x).argmax(1) if top else np.zeros(len(x))
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *batch.columns], ["part", "v", "h"])

    def fit_part(key: tuple, rows: pa.Table) -> pa.Table:
        x = matrix(rows.column("v"), np.float64)[np.argsort(rows.column("h").to_numpy(), kind="stable")[:SAMPLE]]
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([pickle.dumps(fit(x, inner))], pa.binary())], ["part", "router"])

    kind = dict(vectors.dtypes)["v"]
    drawn = hashed(vectors, 2 * SAMPLE * tops / n).mapInArrow(place, f"part int, v {kind}, h long")
    rows = drawn.groupBy("part").applyInArrow(fit_part, "part int, router binary").collect()
    below = {r["part"]: router for r in rows if (router := pickle.loads(r["router"])) is not None}
    return Tree(top, below), points


def search(rows: DataFrame, *, k: int = 20, every: int = 20, cover: float = COVER, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products found for the rows whose id is divisible by every.

    Every row is indexed; the samples bound only what graphs and classifiers are fitted to. Probes go on until they
    cover the share cover of a query's probability and hold 4 * k vectors, so a query never gets fewer than k answers
    if there are as many candidates. Defined results: vectors that are null, empty, zero, of another length than most,
    or hold null or non-finite components take no part, nor do rows without id; ties go to the smaller id; rows of one
    id and vector count as one; no rows, no answers; other columns are ignored.
    """
    whole = usable(rows, vec_id, vector, zero=False).distinct()
    vectors = written(distinct_vectors(whole, k + 1), "ann-vectors")
    queries = whole.where(F.col("vec_id") % every == 0)
    cells, routed = index(vectors, queries, k, cover)
    return answers(queries, solve(cells, routed, k + 1, "double", exact=False), k)


def index(vectors: DataFrame, queries: DataFrame, k: int, cover: float) -> tuple[DataFrame, DataFrame]:
    """All distinct vectors by part (cell, chunk, v, ids), and queries by the parts that they probe (cell, chunk, q, v, least)."""
    tree, points = learn(vectors, vectors.count())
    cells, known = dealt(vectors, lambda x: (tree.home(x), np.zeros(len(x))), "ann-cells")
    home = tree.home(points) if len(points) else np.zeros(0, np.int64)

    def route(batches):
        for batch in batches:
            x = matrix(batch.column(1), np.float64)
            if not len(x):
                continue
            scores = x @ points.T
            owner, cell, chunk, least = [], [], [], []
            for i, (names, odds) in enumerate(tree.probable(x, cover)):
                mass, held, probed = 0.0, 0, []
                more = [c for c in known if c not in set(names.tolist())] if sum(known.get(c, (0,))[0] for c in names.tolist()) < 4 * k else []
                for c, p in [*zip(names.tolist(), odds.tolist(), strict=True), *((c, 0.0) for c in sorted(more))]:
                    mass += p
                    if c in known:
                        held += known[c][0]
                        owner += [i] * known[c][1]
                        cell += [c] * known[c][1]
                        chunk += range(known[c][1])
                        probed.append(c)
                    if mass >= cover and held >= 4 * k:
                        break
                # points of the sample that lie in the probes are found there, so what is worse than k + 1 of them is no answer
                least += [kth_best(scores[i][np.isin(home, probed)], k)] * sum(known[c][1] for c in probed)
            moved = (c.take(pa.array(owner, pa.int64())) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(chunk, pa.int32()), *moved, pa.array(least, pa.float64())], ["cell", "chunk", "q", "v", "least"])

    return cells, asked(queries).mapInArrow(route, "cell int, chunk int, q long, v array<double>, least double")
