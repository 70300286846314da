"""Documents: chunks, claims with their places, links to facts, search."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.periods import parse_period
from ..functions.text import CLAIMS
from .store import if_small, scratch

#: A chunk's words: at most, and at least unless nothing follows.
MOST, LEAST = 300, 150
DIMENSIONS = 384
_sentence = re.compile(r"(?:[^.!?]|[.!?](?=\S))*[.!?]+(?=\s|$)\s*|.+$", re.S)
_digit = re.compile(r"\d")
_claims = {kind: re.compile(pattern) for kind, pattern in CLAIMS.items()}


def _count(text: str) -> int:
    """Words between white space; an empty text has one."""
    return len(text.split()) or 1


def is_heading(paragraph: str) -> bool:
    """Up to five words, in capitals, or titled, short and not ended like a sentence."""
    return len(paragraph.split()) <= 5 and (paragraph.isupper() or (paragraph.istitle() and len(paragraph) < 80 and paragraph[-1] not in ".!?"))


def _sections(text: str, section: str) -> list[tuple[str, str]]:
    out: list[tuple[str, list[str]]] = [(section, [])]
    for paragraph in (p.strip() for p in re.split(r"\n\s*\n", text)):
        if paragraph and is_heading(paragraph):
            out.append((paragraph, []))
        elif paragraph:
            out[-1][1].append(paragraph)
    return [(name, "\n\n".join(body)) for name, body in out if body]


def _packed(body: str) -> list[str]:
    """A long section in runs of sentences, each run beginning with the last sentence of the one before."""
    runs, current, words = [], [], 0  # current: sentences with their words
    for s in (m.group().strip() for m in _sentence.finditer(body)):
        if not s:
            continue
        n = _count(s)
        if current and words + n > MOST:
            runs.append(" ".join(t for t, _ in current))
            current = [current[-1]] if current[-1][1] + n <= MOST else []
            words = sum(k for _, k in current)
        current.append((s, n))
        words += n
    return [*runs, " ".join(t for t, _ in current)] if current else runs


def chunk_text(text: str, section: str = "") -> list[tuple[str, str]]:
    """(section, text) chunks of a document: no word is lost, headings name the chunk that follows, short chunks join the next of them."""
    chunks: list[tuple[str, str]] = []
    for name, body in _sections(text, section):
        chunks += [(name, body)] if _count(body) <= MOST else [(name, run) for run in _packed(body)]
    if not chunks:
        return [(section, text.strip())]
    out, last = [chunks[0]], _count(chunks[0][1])
    for name, body in chunks[1:]:
        n = _count(body)
        if last < LEAST and last + n <= MOST:
            out[-1] = (out[-1][0] or name, f"{out[-1][1]}\n\n{body}")
            last += n
        else:
            out.append((name, body))
            last = n
    return out


def find_claims(text: str, radius: int = 50) -> list[dict]:
    """Numerical claims with what surrounds them, by kind, then place. All of them hold a digit."""
    if not _digit.search(text):
        return []
    return [
        {"number": m.group(), "type": kind, "context": text[max(0, m.start() - radius) : m.end() + radius]}
        for kind, pattern in _claims.items()
        for m in pattern.finditer(text)
    ]


_CLAIMS_TYPE = "numerical_claims array<struct<number: string, type: string, context: string>>, contains_numerical_claim boolean"
_claims_type = pa.list_(pa.struct([("number", pa.string()), ("type", pa.string()), ("context", pa.string())]))


def _claim_columns(texts: list[str | None]) -> list[pa.Array]:
    claims = [find_claims(t or "") for t in texts]
    return [pa.array(claims, _claims_type), pa.array([any(c["type"] != "bare_large_number" for c in x) for x in claims], pa.bool_())]


def chunk_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", claims: bool = False) -> DataFrame:
    """key, chunk_index, section_path, raw_text of every document; packing sentences with a carry is the one sequential step, done in Arrow batches.

    claims: with what with_claims() adds, in the same pass.
    """
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, index, section, body = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for k, (name, part) in enumerate(chunk_text(t or "")):
                    owner.append(i)
                    index.append(k)
                    section.append(name)
                    body.append(part)
            columns = [batch.column(0).take(pa.array(owner, pa.int32())), pa.array(index, pa.int32()), pa.array(section, pa.string()), pa.array(body, pa.string())]
            names = [key, "chunk_index", "section_path", "raw_text"]
            if claims:
                columns, names = columns + _claim_columns(body), [*names, "numerical_claims", "contains_numerical_claim"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunk_index int, section_path string, raw_text string" + f", {_CLAIMS_TYPE}" * claims)


def with_claims(chunks: DataFrame, text: str = "raw_text") -> DataFrame:
    """chunks with numerical_claims and contains_numerical_claim."""
    at = chunks.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_claim_columns(batch.column(at).to_pylist())], [*batch.schema.names, "numerical_claims", "contains_numerical_claim"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)
    return chunks.mapInArrow(run, f"{schema}, {_CLAIMS_TYPE}")


def link_to_facts(chunks: DataFrame, live: DataFrame, *, by: str = "entity_id", text: str = "raw_text", claims: str = "numerical_claims") -> DataFrame:
    """chunks with linked_periods, linked_metrics and linked_fact_ids: facts of the periods they claim and of the metrics they name.

    An entity's facts are few and come as one row for each entity, so chunks are neither multiplied nor sorted. That row
    is written once, with the ids by period and by metric. What a text claims and names is computed once for each chunk:
    no lambda refers to it, as Spark would put the whole expression into the lambda, and so compute it for each fact.
    """
    facts = live.groupBy(by).agg(F.collect_set(F.struct("fact_id", "period", F.col("canonical_field").alias("metric"))).alias("__facts"))
    of = lambda c: F.filter(F.array_distinct(F.transform("__facts", lambda f: f[c])), lambda x: x.isNotNull())
    ids = lambda c: F.map_from_arrays(of(c), F.transform(of(c), lambda x: F.transform(F.filter("__facts", lambda f: f[c] == x), lambda f: f["fact_id"])))
    needle = lambda m: F.concat(F.lit(" "), F.translate(m, "_", " "), F.lit(" "))
    metrics = F.transform(of("metric"), lambda m: F.struct(m.alias("metric"), needle(m).alias("words")))
    facts = scratch(facts.select(by, ids("period").alias("__by_period"), ids("metric").alias("__by_metric"), metrics.alias("__metrics")), "facts")
    joined = chunks.join(if_small(facts, 10_000), by, "left")
    none = F.array().cast("array<string>")
    claimed = F.filter(F.transform(F.filter(claims, lambda c: c["type"] == "period"), lambda c: parse_period(c["number"])), lambda p: p.isNotNull())
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    named = F.array_compact(F.zip_with("__metrics", F.array_repeat(low, F.size("__metrics")), lambda m, t: F.when(t.contains(m["words"]), m["metric"])))
    known = F.array_intersect(claimed, F.map_keys("__by_period"))
    out = joined.withColumns({"linked_periods": F.array_sort(F.coalesce(known, none)), "linked_metrics": F.array_sort(F.coalesce(named, none))})
    found = lambda linked, by_name: F.transform(linked, lambda x: F.try_element_at(F.col(by_name), x))
    both = F.concat(found("linked_periods", "__by_period"), found("linked_metrics", "__by_metric"))
    return out.withColumn("linked_fact_ids", F.array_sort(F.array_distinct(F.flatten(both)))).drop("__by_period", "__by_metric", "__metrics")


def hashed_words(texts: list[str]) -> np.ndarray:
    """The default encoder: hashed words, with signs, at unit length."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, t in enumerate(texts):
        for w in re.findall(r"\w+", t.lower()):
            h = zlib.crc32(w.encode())
            out[i, h % DIMENSIONS] += 1 - 2 * (h >> 31)
    return out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))


def embed(text: Column, encoder=None) -> Column:
    """A vector for each text: by an injected encoder (list of texts -> matrix), by default hashed words of fixed dimension."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    work = encoder or hashed_words

    def vectors(texts):
        return pd.Series(list(work([t or "" for t in texts])))

    vectors.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return pandas_udf(vectors, "array<float>")(text)


def keyword_score(text: Column, query: str) -> Column:
    """How many words of the query (longer than two letters) a text holds."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if len(t) > 2]
    score = F.lit(0)
    for t in terms:
        score = score + F.lower(text).contains(t).cast("int")
    return score


def keyword_search(chunks: DataFrame, query: str, k: int = 8, text: str = "raw_text") -> DataFrame:
    order = [F.desc("score"), *(c for c in ("chunk_index", "chunk_id") if c in chunks.columns)]
    return chunks.withColumn("score", keyword_score(F.col(text), query)).where("score > 0").orderBy(*order).limit(k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_search(chunks: DataFrame, vector: list[float], k: int = 8, by: str = "file_id", embedding: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k nearest of each file: ranks are limited before the shuffle, so no file's chunks meet in one task."""
    scored = chunks.withColumn("score", cosine(F.col(embedding), F.array(*[F.lit(float(x)) for x in vector])))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return scored.withColumn("place", place).where(F.col("place") <= k)
