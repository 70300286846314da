"""Toxicity: gradients against differences, sentences against a plain splitter, held-out accuracy, odd input."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import queries, toxicity
from tallyforge.llm.toxicity import codes_of, loss, pieces, score, sentences, softplus, train

BAD = ["vile", "rotten", "filthmonger", "dunghead"]


def document(r, bad, n=12):
    said = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 9))) for _ in range(n)]
    offending = sorted(r.sample(range(n), 2)) if bad else []
    for k in offending:
        said[k] += " " + r.choice(BAD) + r.choice(["", "s", "ly"]) + " x" * r.randint(0, 2)
    return ". ".join(said) + ".", offending


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    return train([(document(r, i % 4 == 0)[0], int(i % 4 == 0)) for i in range(300)])


def plain(text):
    """Spans of sentences, of 40 words at most, by regular expressions."""
    out = []
    for m in re.finditer("[^.!?\n\r…。！？\0]+", text):
        words = [w for w in re.finditer(r"[^\W_]+", m[0])]
        for k in range(0, len(words), 40):
            out.append((m.start() + words[k].start(), m.start() + words[min(k + 39, len(words) - 1)].end()))
    return out


TEXTS = ["One two. Three!four? \n\n five", "", "...", "a" * 300, "w " * 200, "É ß ǅ İ 7x. \U0001f600 y", "no end " * 50 + ". short", "x\0y z. q"]


@pytest.mark.parametrize("text", TEXTS)
def test_sentences_equal_a_plain_splitter(text):
    found = sentences(codes_of([text]))
    assert list(zip(found.start.tolist(), found.end.tolist())) == plain(text)


def test_gradient_of_the_noisy_or():
    r = np.random.default_rng(1)
    z, first, toxic, weight = r.normal(-1, 2, 20), np.array([0, 3, 4, 12]), np.array([True, False, True, False]), np.array([0.1, 0.4, 0.3, 0.2])
    got = loss(z, first, toxic, weight)
    chance = [1 - np.prod(1 - 1 / (1 + np.exp(-x))) for x in np.split(z, first[1:])]
    assert got[0] == pytest.approx(sum(-w * np.log(p if y else 1 - p) for p, y, w in zip(chance, toxic, weight)))
    for k in range(20):
        up, down = z.copy(), z.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        assert got[1][k] == pytest.approx((loss(up, first, toxic, weight)[0] - loss(down, first, toxic, weight)[0]) / 2e-5, abs=1e-7)


def test_documents_and_their_sentences_are_found(model):
    r = random.Random(2)
    right = located = 0
    for i in range(200):
        text, offending = document(r, i % 2)
        [(p, spans)] = score(model, [text])
        right += (p >= 0.5) == bool(i % 2)
        assert p == pytest.approx(1 - np.prod([1 - s for _, _, s in spans]))
        located += [k for k, s in enumerate(spans) if s[2] >= 0.5] == offending
    assert right >= 195 and located >= 180


def test_learning_needs_both_kinds():
    assert train([]) is None and train([("a b", 0)]) is None and train([("a b", 1), ("", 0), ("...", 0)]) is None
    assert score(None, ["x", None]) == [(0.0, []), (0.0, [])]


def test_long_texts_are_scored_in_pieces(model, monkeypatch):
    r = random.Random(3)
    texts = [document(r, i % 2, 60)[0] for i in range(6)] + TEXTS + ["a" * 5000 + ". vile", "vile " * 3000, "\n" * 4000 + "rotten"]
    whole = score(model, texts)
    monkeypatch.setattr(toxicity, "WORK", 700)
    assert len(list(pieces(texts[0]))) > 1
    for (p, spans), (q, same) in zip(whole, score(model, texts), strict=True):
        assert p == pytest.approx(q) and spans == [(s, e, pytest.approx(x)) for s, e, x in same]


def test_odd_input(spark, model):
    r = random.Random(4)
    bad, _ = document(r, True)
    rows = [(1, None), (2, ""), (3, "..."), (4, bad), (4, bad), (None, bad), (5, bad + " calm" * 100_000), (6, "calm " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS worst", "3 AS `a.b`", "4 AS `row`", "5 AS start")
    out = toxicity.toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "a.b", "row", "start", "score", "predicted", "offending", "worst"]
    got = out.collect()
    assert [(g["predicted"], g["worst"] is None) for g in got] == [(0, True)] * 3 + [(1, False)] * 4 + [(0, False)] and got[3]["score"] == got[4]["score"] == got[5]["score"]
    found = toxicity.offending(docs, model, keep=["doc_id", "text", "row"])
    assert found.columns == ["doc_id", "text", "row", "start", "end", "score", "sentence"]
    assert all(x["sentence"] == x["text"][x["start"] : x["end"]] for x in found.collect()) and found.where("doc_id = 4").count() == 4
    assert toxicity.toxicity(docs.limit(0), model).collect() == [] and toxicity.toxicity(docs, None).agg(F.max("score"), F.max("predicted")).first()[:] == (0.0, 0)


def test_odd_labels(spark):
    r = random.Random(5)
    docs = spark.createDataFrame([(i, document(r, i % 3 == 0)[0]) for i in range(150)] + [(150, None), (151, ""), (None, "vile"), (3, "again the same id")], "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(152)]
    schema = "doc_id long, toxic int"
    first = toxicity.learn(docs, spark.createDataFrame(labels, schema))
    more = [(None, 1), (7, None), (8, 5), (9_999, 1), (10_000, 0)]
    again = toxicity.learn(docs.repartition(3), spark.createDataFrame(labels[::-1] + more, schema).selectExpr("*", "1 AS text", "2 AS draw"))
    assert np.array_equal(first.weights, again.weights) and first.bias == again.bias
    assert toxicity.learn(docs, spark.createDataFrame([], schema)) is None and toxicity.learn(docs, spark.createDataFrame([(1, 0)], schema)) is None
    assert toxicity.learn(docs.limit(0), spark.createDataFrame(labels, schema)) is None


def test_held_out_labels_are_not_learned(spark):
    from zlib import crc32

    r = random.Random(6)
    docs = spark.createDataFrame([(i, document(r, i % 3 == 0)[0]) for i in range(150)], "doc_id long, text string")
    labels = [(i, int(i % 3 == 0)) for i in range(150)]
    turned = [(i, y if crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    a, b = (toxicity.learn(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights)


def test_softplus_is_stable():
    assert softplus(np.array([-800.0, 0.0, 800.0])).tolist() == [0.0, pytest.approx(np.log(2)), 800.0]


def test_query_on_held_out_documents(spark):
    at = "/root/testdata/sf0.1"
    got = queries.op11_toxicity(spark, at)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{at}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, hits, alarms = sum(y for y, _ in judged), sum(y and p for y, p in judged), sum(p and not y for y, p in judged)
    assert hits >= 0.8 * toxic and alarms <= 0.01 * (len(judged) - toxic)
