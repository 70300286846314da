"""A corpus pipeline of operators: language, near copies, personal data, mix, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import jaccard, langid, mixing, packing, pii
from tallyforge.llm.common import col, free_name, table, written

#: A document whose words are this unsure of their languages on average is rejected, as is one without letters.
LEAST_SURE = 0.4

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Every stage: null, empty and very long texts, repeated rows, rows without id, empty tables and columns of any name are
# allowed, columns pass through as they are, and nothing is chosen by the order of rows. What a stage does with them:


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; the model learns from the labels among them.

    Rejected are null, empty and letterless texts, and texts whose words fit no language: those whose likeliest
    languages have a mean probability below LEAST_SURE, however many languages a text switches between. Without labels
    to learn from only letterless texts go. Repeated rows are judged alike; an empty table stays empty.
    """
    names = [free_name(n, docs.columns) for n in ("__lang", "__share", "__sure")]
    model = langid.learn(docs)
    if model is None:
        return docs.where(F.coalesce(col("text").rlike(r"\p{L}"), F.lit(False)))
    found = langid.identify(docs, model, names=tuple(names))
    return found.where((F.col(names[0]) != langid.UNKNOWN) & (F.col(names[2]) >= LEAST_SURE)).select(*map(col, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The one with the smallest doc_id stays, rows without doc_id last; texts without words all stay; rows that share a
    doc_id are judged by their texts; a very long text is compared as a whole; an empty table stays empty.
    """
    return jaccard.deduplicated(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    Null and empty texts and all rows stay, repeated ones too; n_chars, where there is one, follows the text; a table
    without texts to train on is searched by the fixed patterns alone.
    """
    return pii.redacted(docs, pii.train(pii.sample(docs)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    Texts without words count as none and come as often as their place in the order says; a null source is a source;
    repeated rows are documents of their own; no document comes more than three times; an empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with the sequence that each is packed into and its place there.

    A null or empty text is a piece of its end mark; a very long one is cut into pieces that cover it; repeated rows are
    pieces of their own; no documents, no pieces.
    """
    return packing.pack(docs, with_text=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("pii", personal_data),
    ("mix_sources", mix),
    ("best_fit_packing", pack),
]

#: SQL cannot express trained models; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
