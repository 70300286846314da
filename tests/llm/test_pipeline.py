"""Every stage of the corpus pipeline on its own input, and all together."""

import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import packing

from .test_operators import brute_classes, check_bins, empty, naive, odd


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_language_keeps_clean_documents(spark, docs, sf):
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * docs.count()
    junk = docs.limit(3).withColumn("text", F.lit("12 34 !!"))
    assert corpus_pipeline.language(spark, docs.union(junk), sf).where("text = '12 34 !!'").count() == 0


def test_near_copies_leave_one_of_each_group(spark, docs, sf):
    copies = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)
    both = docs.union(copies)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, both, sf).collect())
    want = brute_classes([(r.doc_id, r.text) for r in both.collect()], 5, 80)
    assert kept == sorted(d for d, _, c in want if d == c)


def test_personal_data_goes(spark, docs, sf):
    out = {r.doc_id: r for r in corpus_pipeline.personal_data(spark, docs, sf).collect()}
    for r in docs.collect():
        spans = naive(r.text)
        assert naive(out[r.doc_id].text) == [] and out[r.doc_id].n_chars == len(out[r.doc_id].text)
        if not spans and not any(c.isdigit() or c == "@" for c in r.text):
            assert out[r.doc_id].text == r.text


def test_mix_repeats_documents(spark, docs, sf):
    out = corpus_pipeline.mix(spark, docs, sf)
    assert out.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 3


def test_run_and_each_stage_on_odd_input(spark, sf):
    out = corpus_pipeline.run(spark, sf).collect()
    check_bins(out, packing.SIZES)
    assert len(out) > 0 and zlib.crc32(b"") == 0
    for name, stage in corpus_pipeline.STAGES:
        for frame in (odd(spark), empty(spark)):
            result = stage(spark, frame, sf)
            result.collect()
            if name != "best_fit_packing":
                assert result.columns == frame.columns
