"""Spelling variants against brute force over all pairs."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tallyforge.llm import queries, variants
from tallyforge.llm.variants import WaveletTree, count_words, near_pairs, occurrences


def one_edit(a, b):
    """Whether a and b differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts, ratio=5):
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, counts, **options):
    rows = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), **options)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 8, 100, 257])
def test_wavelet_tree_reports_every_point(n):
    rng = np.random.default_rng(n)
    values = rng.permutation(n)
    (left, right), (low, high) = (np.sort(rng.integers(0, n + 1, (2, 200)), 0) for _ in range(2))
    which, got = WaveletTree(values).report(left, right, low, high)
    want = sorted((q, v) for q in range(200) for v in values[left[q] : right[q]].tolist() if low[q] <= v < high[q])
    assert sorted(zip(which.tolist(), got.tolist())) == want


def vocabulary(n, seed, alphabet="abé", prefix=""):
    r = random.Random(seed)
    words = {prefix + "".join(r.choice(alphabet) for _ in range(r.randint(6, 9))) for _ in range(n)}
    return {w: r.choice([5, 6, 30, 31, 200, 1000, 5000]) for w in sorted(words)}


@pytest.mark.parametrize("group,cells", [(20_000, 4_000_000), (40, 4_000_000), (1, 500)])
def test_variants_equal_brute_force(spark, monkeypatch, group, cells):
    monkeypatch.setattr(variants, "GROUP", group)
    monkeypatch.setattr(variants, "CELLS", cells)
    counts = vocabulary(500, 1) | vocabulary(200, 2, "xyzw", "shared")
    assert found(spark, counts) == brute(counts)


def test_a_prefix_that_all_words_share_is_split(spark, monkeypatch):
    monkeypatch.setattr(variants, "GROUP", 50)
    counts = vocabulary(600, 3, "abcdefgh", "anticonstitution")
    largest = variants.windows(spark.createDataFrame(list(counts.items()), "word string, n long")).groupBy(*variants.KEY).count().where("hi > lo").agg({"count": "max"}).first()[0]
    assert largest <= 50 and found(spark, counts) == brute(counts)


def test_ties_chains_and_lone_words(spark):
    counts = {"aaaaaa": 5, "aaaaab": 25, "aaaaac": 25, "aaaabb": 125, "aaabbb": 625, "zzzzzz": 5, "zzzzzzz": 24, "qqqqqqqq": 9, "\U0001f600bcdef": 5, "￿bcdef": 30}
    rows = {r[0]: r for r in found(spark, counts)}
    assert list(rows.values()) == brute(counts)
    assert rows["aaaaaa"][1:3] == ("aaaaab", "aaabbb") and rows["zzzzzz"][1] is None and rows["qqqqqqqq"] == ("qqqqqqqq", None, "qqqqqqqq", 9, 0, None)


def test_very_long_words_and_no_words(spark):
    long = "ab" * 3000
    counts = {long: 100, long[:-1]: 6, long[1:]: 7, long[:3000] + "x" + long[3000:]: 5, "other" * 4: 5}
    assert found(spark, counts) == brute(counts)
    assert found(spark, {}) == []
    assert near_pairs(spark.createDataFrame([("single", 7)], "word string, n long")).collect() == []


def plain_counts(docs, spoilt):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{i}:{word}".encode())
            if spoilt and i is not None and h % spoilt == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


@pytest.mark.parametrize("spoilt", [0, 3])
def test_words_of_odd_documents(spark, spoilt):
    r = random.Random(4)
    words = ["Réseau", "ÉCOLES", "straße", "Wörter", "seven77eight", "x×÷yzab", "abcdef\U00010400ghijkl", "ǅabcdef", "a" * 20]
    docs = [(i, " ".join(r.choice(words) for _ in range(30))) for i in range(40)] + [(None, "Nothing Nothing Nothing Nothing Nothing"), (7, None), (8, ""), (9, "1 2 3"), (3, "longer " * 50_000), (3, "longer " * 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS id", "3 AS n")
    assert dict(map(tuple, count_words(occurrences(df, spoilt=spoilt)).collect())) == plain_counts(docs, spoilt)


def test_query_equals_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op12_spelling_variants(spark, sf).collect()))
    counts = plain_counts(docs, 199)
    assert got == brute(counts)
