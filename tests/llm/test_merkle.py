"""Merkle manifests against a plain recursive tree."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(digests):
    """Root, and for each leaf the digests before and after it at each level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        runs = [level[i : i + 3] for i in range(0, len(level), 3)]
        for leaf_, k in enumerate(at):
            run = runs[k // 3]
            paths[leaf_].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        at, level = [k // 3 for k in at], [H(*r) for r in runs]
    return (level or [None])[0], paths


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of all rows, sorted."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    keys = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {k: tree([leaf(r) for r in sorted(by_source[k], key=order)]) for k in keys}
    root, over = tree([trees[k][0] for k in keys])
    out = []
    for k, above in zip(keys, over, strict=True):
        for r, path in zip(sorted(by_source[k], key=order), trees[k][1], strict=True):
            out.append((r[0], leaf(r), trees[k][0], root, tuple(path + above)))
    return sorted(out, key=repr)


def made(spark, rows, **options):
    found = merkle.manifest(spark.createDataFrame(rows, SCHEMA), keep=["doc_id"], **options)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    return sorted(((r[0], r[1], r[2], r[3], tuple((s["before"], s["after"]) for s in r["proof"])) for r in found.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5, 6])
def test_paths_equal_the_plain_tree(levels):
    for n in [*range(1, 31), 80, 81, 82, 242, 243, 244, 500, 729]:
        if n <= 3**levels:
            digests = [H(str(i)) for i in range(n)]
            own = merkle.height(n)
            plain = tree(digests)
            got = list(merkle.paths(digests, own))
            assert got == plain[1]
            if levels > own:  # a block right of others is hashed up to their height, however few its leaves
                taller = list(merkle.paths(digests, levels))
                assert [p[:own] for p in taller] == got and all(step == ("", "") for p in taller for step in p[own:])


def test_memory_of_a_traversal_is_two_subtrees_a_band():
    kept = []

    class Counted(merkle._Subtree):
        def __init__(self, low, high):
            super().__init__(low, high)
            kept.append(self)

    original, merkle._Subtree = merkle._Subtree, Counted
    try:
        for _ in merkle.paths([H(str(i)) for i in range(729)], 6):
            alive = kept[-2 * 3 :]
            assert sum(len(row) for tree_ in alive for row in tree_.kept) <= 6 * (9 + 3)
    finally:
        merkle._Subtree = original


ODD = [
    (3, "b", "en", 1, "x\ny"), (1, "b", None, None, None), (2, None, "de", 3, "äöü"), (2, None, "de", 3, "äöü"), (None, "b", "en", 0, ""),
    (None, None, None, None, None), (7, "", "fr", 2, "\U0001f600"), (-5, "ä", "en", 2, "ab" * 50_000), (3, "b", "en", 1, "x\ny"), (3, "b", "en", 2, "other"),
]


def test_odd_rows(spark):
    assert made(spark, ODD) == brute(ODD)
    assert made(spark, ODD[::-1]) == brute(ODD)
    assert made(spark, ODD[:1]) == brute(ODD[:1])
    assert made(spark, ODD[:3]) == brute(ODD[:3])
    assert made(spark, []) == []


def test_one_and_many_sources(spark):
    one = [(i, "s", "en", i, f"t{i}") for i in range(40)]
    many = [(i, f"s{i}", "en", i, f"t{i}") for i in range(40)]
    assert made(spark, one) == brute(one)
    assert made(spark, many) == brute(many)


def test_blocks_over_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i * 7 % 1009, "hot" if i % 3 else f"s{i % 11}", "en", i, f"text {i}") for i in range(1000)] + ODD
    assert made(spark, rows) == brute(rows)


def test_columns_of_any_name(spark):
    df = spark.createDataFrame(ODD, SCHEMA).select("*", F.lit(1).alias("leaf"), F.lit(2).alias("key"), F.lit(3).alias("idx"), F.lit(4).alias("a.b"), F.create_map(F.lit("m"), F.lit(1)).alias("tie"))
    out = merkle.manifest(df)
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "text", "key", "idx", "a.b", "tie", "leaf", "subroot", "root", "proof"]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["leaf"]) for r in out.collect()) == sorted((r[0] is None, r[0] or 0, r[1]) for r in brute(ODD))


def test_proofs_find_what_was_changed(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"a{i}\nb") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = merkle.manifest(docs, keep=["doc_id", "text"])
    read = out.withColumn("text", merkle.tampered(F.col("text"), F.col("doc_id"))).join(docs.drop("text"), "doc_id")
    found = read.withColumn("to", merkle.folded(merkle.leaf([F.col(c) for c in merkle.FIELDS]), F.col("proof"))).collect()
    from zlib import crc32

    assert all((r["to"] == r["root"]) == (crc32(str(r["doc_id"]).encode()) % 2 == 1) for r in found) and len(found) == 30
