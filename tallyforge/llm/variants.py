"""Spelling variants: words that differ by one inserted, deleted or replaced code point, found by two-dimensional range reporting.

Words in forward order have an interval for each prefix, words in order of their reversals one for each suffix. A word
with a fault at position i has the prefix before i and the suffix after it in common with its variants, so these are the
points of a rectangle, prefix interval by suffix interval, among the points (forward rank, reverse rank) of all words of
one length. A wavelet tree over the reverse ranks in forward order reports a rectangle's points level by level, for many
rectangles at once.

Words meet by windows of positions: for a window from lo to hi, only words that share the lo code points before it and
all code points after it can be variants. Each length starts with two windows, the halves of a word; the groups that are
larger than GROUP are halved again, down to single positions, whose groups are no larger than the alphabet. So a prefix
that half of the vocabulary shares is split without losing a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, if_small, looked_up, remove, written

#: Letters of a run.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Fewest code points and occurrences of a word, and how many times more frequent a form is.
SHORTEST, RAREST, RATIO = 6, 5, 5
#: Words of a group, beyond which its window is halved; words of a partition, and code points that are worked on at once.
GROUP, PART, CELLS = 20_000, 250_000, 4_000_000


# ---- words


def occurrences(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", spoilt: int = 0) -> DataFrame:
    """word of each run of letters, A-Z in lower case; spoilt: of one run of so many, by a CRC of doc_id and run, a code point is deleted."""
    upper = "".join(map(chr, range(65, 91)))
    found = docs.select(col(doc_id).cast("string").alias("id"), F.explode(F.regexp_extract_all(col(text), F.lit(LETTERS), F.lit(0))).alias("word"))
    found = found.withColumn("word", F.translate("word", upper, upper.lower()))
    if not spoilt:
        return found.select("word")
    crc = F.crc32(F.concat(F.col("id"), F.lit(":"), F.col("word")).cast("binary"))
    at = F.pmod(crc, F.length("word")).cast("int")
    without = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return found.select(F.when(crc % spoilt == 0, without).otherwise(F.col("word")).alias("word"))


def count_words(runs: DataFrame, shortest: int = SHORTEST, rarest: int = RAREST) -> DataFrame:
    """word, n of the words that are long and frequent enough; counted before they are shuffled, so that no word is hot."""
    return runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= rarest)


# ---- range reporting


class WaveletTree:
    """A permutation of 0..n-1, level by level from the highest bit; at each level the zeros of that bit come first."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all values in [low, high) at the places in [left, right), for many rectangles."""
        which, base = np.arange(len(left)), np.zeros(len(left), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.bits - 1 - level)
            zl, zr, all_zeros = zeros[left], zeros[right], zeros[-1]
            which, base = np.concatenate([which, which]), np.concatenate([base, base + half])
            left, right = np.concatenate([zl, all_zeros + left - zl]), np.concatenate([zr, all_zeros + right - zr])
            kept = (left < right) & (base < high[which]) & (base + half > low[which])
            which, base, left, right = which[kept], base[kept], left[kept], right[kept]
        return which, base


def _order(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by group and codes, and how many codes each row of it shares with the row before; -1 where a group begins."""
    keyed = np.ascontiguousarray(np.concatenate([group[:, None] + 1, codes], 1).astype(">u4"))
    order = np.argsort(keyed.view(f"S{keyed.shape[1] * 4}").ravel(), kind="stable")
    a, g = codes[order], group[order]
    shared = np.full(len(a), -1, np.int64)
    same = np.logical_and.accumulate(a[1:] == a[:-1], axis=1).sum(1)
    shared[1:] = np.where(g[1:] == g[:-1], same, -1)
    return order, shared


def _intervals(shared: np.ndarray, depth: int, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row in order, the interval, counted in targets, of the rows that share depth codes with it."""
    new = shared < depth
    run, begin = np.cumsum(new) - 1, np.flatnonzero(new)
    return targets[begin][run], targets[np.append(begin[1:], len(shared))][run]


def near(words: list[str], group: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> np.ndarray:
    """Pairs (i, k) of words of one group, where word k has size code points and word i becomes it by replacing or inserting one at a position from low to high.

    words have size or size - 1 code points. group is ascending; its words are distinct and share what its window says.
    """
    lengths = np.array([len(w) for w in words])
    width = size
    ends = np.frombuffer("".join(w.rjust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)[:, ::-1]
    starts = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)
    is_target = lengths == size
    f_order, f_shared = _order(starts, group)
    r_order, r_shared = _order(ends, group)
    f_targets = np.concatenate([[0], np.cumsum(is_target[f_order])])
    r_targets = np.concatenate([[0], np.cumsum(is_target[r_order])])
    if not f_targets[-1]:
        return np.zeros((0, 2), np.int64)
    r_place = np.empty(len(words), np.int64)
    r_place[r_order] = np.arange(len(words))
    f_rows, r_rows = f_order[is_target[f_order]], r_order[is_target[r_order]]  # of targets, by rank
    tree = WaveletTree(r_targets[r_place[f_rows]])
    f_place = np.empty(len(words), np.int64)
    f_place[f_order] = np.arange(len(words))
    found = []
    for i in range(int(low.min()), int(high.max()) + 1):
        asked = np.flatnonzero((low <= i) & (i <= high))
        left, right = (x[f_place[asked]] for x in _intervals(f_shared, i, f_targets))
        bottom, top = (x[r_place[asked]] for x in _intervals(r_shared, size - 1 - i, r_targets))
        own = is_target[asked]  # is itself one of the points
        some = (right - left > own) & (top - bottom > own)
        which, value = tree.report(left[some], right[some], bottom[some], top[some])
        pairs = np.stack([asked[some][which], r_rows[value]], 1)
        found.append(pairs[pairs[:, 0] != pairs[:, 1]])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


# ---- windows


def _entries(words: DataFrame) -> DataFrame:
    """Each word in the windows of the lengths that it can become or be: word, n, size, lo, hi."""
    length = F.length("word")
    halves = lambda size: [F.struct(size.alias("size"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in ((F.lit(0), F.floor(size / 2) - 1), (F.floor(size / 2), size - 1))]
    return words.select("word", "n", F.explode(F.array(*halves(length), *halves(length + 1))).alias("w")).select("word", "n", "w.*")


def _keyed(entries: DataFrame) -> DataFrame:
    """entries with head and tail: what the words of a window share."""
    after = F.col("size") - 1 - F.col("hi")
    return entries.withColumns({"head": F.substring("word", F.lit(1), F.col("lo")), "tail": F.substring(F.col("word"), F.length("word") - after + 1, F.greatest(after, F.lit(0)))})


KEY = ["size", "lo", "hi", "head", "tail"]


def windows(words: DataFrame) -> DataFrame:
    """_entries with their keys, in windows whose groups have at most GROUP words or a single position."""
    done, left = None, _keyed(_entries(words))
    while True:
        hot = written(left.groupBy(*KEY).count().where((F.col("count") > GROUP) & (F.col("hi") > F.col("lo"))).drop("count"), "variants-hot")
        if not hot.limit(1).count():
            return left if done is None else done.unionByName(left)
        side = if_small(hot, 100_000)
        cold = left.join(side, KEY, "left_anti")
        done = cold if done is None else done.unionByName(cold)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("from"), middle.alias("to")), F.struct((middle + 1).alias("from"), F.col("hi").alias("to")))).alias("half")
        split = left.join(side, KEY, "left_semi").select("word", "n", "size", halves).select("word", "n", "size", F.col("half.from").alias("lo"), F.col("half.to").alias("hi"))
        left = written(_keyed(split), "variants-windows")


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, near, near_n, both ways and perhaps more than once, of all near words among words (word, n; distinct)."""
    rows = windows(words)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-4 * words.count() // PART))
    dealt = rows.select(*KEY, "word", "n").repartition(parts, *KEY).sortWithinPartitions(*KEY)
    names = ["word", "n", "near", "near_n"]

    def pairs(groups: list[tuple], n_rows: int) -> Iterator[pa.RecordBatch]:
        words = [w for g in groups for w in g[1]]
        if len(groups) == n_rows:  # nothing but lone words
            return
        counts = np.array([n for g in groups for n in g[2]], np.int64)
        sizes = [len(g[1]) for g in groups]
        spread = lambda k: np.repeat([g[0][k] for g in groups], sizes)
        found = near(words, np.repeat(np.arange(len(groups)), sizes), spread(1), spread(2), groups[0][0][0])
        if len(found):
            longer = np.array([len(words[i]) < len(words[k]) for i, k in found.tolist()])
            found = np.concatenate([found, found[longer][:, ::-1]])
            a, b = found[:, 0], found[:, 1]
            texts = pa.array(words, pa.string())
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(a)), pa.array(counts[a]), texts.take(pa.array(b)), pa.array(counts[b])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple] = []  # of one size: key, words, counts
        held, key = 0, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(7)]
            for row in zip(*columns, strict=True):
                if row[:5] != key:
                    if key and (row[0] != key[0] or held * key[0] > CELLS):
                        yield from pairs(groups, held)
                        groups, held = [], 0
                    key = row[:5]
                    groups.append((key, [], []))
                groups[-1][1].append(row[5])
                groups[-1][2].append(row[6])
                held += 1
        if groups:
            yield from pairs(groups, held)

    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n; distinct) with form, root, n_near, form_n: the near word of largest n, if that is at least ratio times the word's, and where forms lead.

    Defined results: equal n are decided by the smallest word in code point order; a word without near words, or without
    one that is frequent enough, has form and form_n null and is its own root; no words, no rows; words of any length are
    compared whole. A word has no more near words than the alphabet and its length allow, so nothing of a group grows
    with the corpus. Chains of forms are as long as the logarithm of counts; they are followed by doubling.
    """
    words = written(words.select("word", "n"), "variants-words")
    pairs = near_pairs(words).repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("near"))).alias("best"))
    enough = -F.col("best.k") >= ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", F.when(enough, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.k")).alias("form_n")
    )
    found = written(found, "variants-forms")
    n_words = found.count()
    roots = written(found.select("word", F.coalesce("form", "word").alias("root"), F.col("form").isNotNull().alias("moved")), "variants-roots")
    while roots.where("moved").limit(1).count():
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = written(looked_up(roots, "root", ahead, n_words, "word").select("word", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "variants-roots")
        remove(roots)
        roots = after
    return found.join(roots.select("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS crc_table),
r AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents) GROUP BY ALL),
b AS (SELECT *, hex(encode(doc_id || ':' || run)) AS bytes FROM r),
h AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT)),
                                 lambda c, x: xor(c >> 8, crc_table[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM b, tab),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, length(word) AS size FROM o WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS MATERIALIZED (
  SELECT word, n, size, pos, substr(word, 1, pos - 1) AS head, substr(word, pos + 1) AS tail FROM (SELECT word, n, size, unnest(range(1, size + 1)) AS pos FROM w)),
p AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM v a JOIN v b USING (size, pos, head, tail) WHERE a.word <> b.word
  UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON w.word = v.head || v.tail
  UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON w.word = v.head || v.tail),
g AS (SELECT word, count(DISTINCT near) AS n_near, max(near_n) AS most FROM p GROUP BY word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * w.n THEN (SELECT min(near) FROM p WHERE p.word = w.word AND near_n = most) END AS form, CASE WHEN most >= 5 * w.n THEN most END AS form_n
  FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word AND c.next IS NULL
"""
