"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's chance of being toxic is a logistic function of the hashes of its words and of their first letters; a
document is toxic if any sentence is (noisy-or): 1 minus the product of the chances that each is not. Only documents have
labels. Features that more toxic documents have than chance would give them tell; a sentence without any has no chance of
being toxic, so that a document does not get worse by its length. The gradient of the noisy-or puts the blame for a toxic
document on the sentences that look worst so far, and clears every sentence of a clean one, so that the sentence scores
come to tell where a document offends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, small_batches, with_fields

#: Bounds of the training sample: toxic documents, clean ones, characters of a document (longer ones are scored, but not learned from).
TOXIC, CLEAN, LONGEST = 1000, 2000, 20_000
#: Words of a sentence; a longer one is scored in pieces of so many.
SENTENCE = 40
#: Places of features, lengths of the beginnings of words that are features, characters that are scored at once.
BITS, BEGINNINGS, WORK = 20, (3, 4, 5, 6, 7), 1_000_000
#: Toxic documents of the sample that a feature must occur in, to have a weight of its own.
LEAST = 3
#: Standard deviations beyond chance.
TELLING = 3
#: Passes over the sample, step, and how strongly weights are drawn to zero.
ROUNDS, STEP, DECAY = 60, 0.1, 5e-5
#: Characters that end a sentence, besides the ends of texts.
ENDS = ".!?\n\r…。！？"
#: From this score on a sentence, or a document, counts as toxic.
TOXIC_FROM = 0.5

_tables: list[np.ndarray] = []


def _characters() -> list[np.ndarray]:
    """By code point: its lower case, whether it belongs to a word, whether it ends a sentence."""
    if not _tables:
        every = list(map(chr, range(0x110000)))
        ends = np.zeros(len(every), bool)
        ends[[0, *map(ord, ENDS)]] = True
        _tables.extend([np.array([ord(x) if len(x := c.lower()) == 1 else i for i, c in enumerate(every)], np.uint32), np.array([c.isalnum() for c in every]), ends])
    return _tables


@dataclass
class Sentences:
    """features of each word; for each sentence its first word, and where it starts and ends."""

    features: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of texts, each followed by a zero."""
    return np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)


def sentences(codes: np.ndarray) -> Sentences:
    """Sentences of code points that end with a zero: from the first letter or digit to the last, pieces of SENTENCE words at most."""
    lower, word, ending = _characters()
    inside = word[codes]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside])))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Sentences(np.zeros((0, 1 + len(BEGINNINGS)), np.int32), none, none, none)
    run = np.cumsum(ending[codes])[start]
    nth = np.arange(len(start))
    fresh = np.concatenate([[True], run[1:] != run[:-1]])
    since = nth - np.maximum.accumulate(np.where(fresh, nth, 0))
    first = np.flatnonzero(since % SENTENCE == 0)
    letters = np.where(inside, lower[codes], 0).astype(np.uint64)
    power = np.cumprod(np.full(max(int((end - start).max()), *BEGINNINGS), 0xD6E8FEB86659FD93, np.uint64))
    place = np.arange(len(codes)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(codes)]])))
    hashes = [np.add.reduceat(letters * power[np.minimum(place, len(power) - 1)], start)]
    begun = np.zeros(len(start), np.uint64)
    for k in range(max(BEGINNINGS)):
        at = start + k
        begun += np.where(at < end, letters[np.minimum(at, len(codes) - 1)], 0).astype(np.uint64) * power[k]
        if k + 1 in BEGINNINGS:
            hashes.append(begun.copy())
    mixed = [(h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS) for k, h in enumerate(hashes)]
    last = np.append(first[1:], len(start)) - 1
    return Sentences(np.stack(mixed, 1).astype(np.int32), first, start[first], end[last])


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def chances(self, found: Sentences) -> np.ndarray:
        """How likely each sentence is toxic, as log odds; minus infinity if nothing in it tells."""
        if not len(found.first):
            return np.zeros(0)
        weights = self.weights[found.features]
        some = np.logical_or.reduceat((weights != 0).any(1), found.first)
        return np.where(some, self.bias + np.add.reduceat(weights.sum(1, dtype=np.float64), found.first), -np.inf)


def softplus(z: np.ndarray) -> np.ndarray:
    """-log of the chance that a sentence is not toxic."""
    return np.logaddexp(0.0, z)


def loss(z: np.ndarray, first: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy of the noisy-or of each document's sentences, and its gradient for the sentences' log odds.

    first: the first sentence of each document; every document has one.
    """
    hidden = np.maximum(np.add.reduceat(softplus(z), first), 1e-9)
    missed = np.where(toxic, -np.log(-np.expm1(-hidden)), hidden)
    blame = np.where(toxic, -1.0 / np.expm1(np.minimum(hidden, 500.0)), 1.0) * weight
    sigmoid = 0.5 * (1 + np.tanh(0.5 * z))
    return float(missed @ weight), np.repeat(blame, np.diff(np.append(first, len(z)))) * sigmoid


def telling(features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Features that more of the toxic documents have than chance would give them: what else a few documents share can only tell which of them it is."""
    seen = np.zeros((2, 1 << BITS))
    for f, y in zip(features, toxic, strict=True):
        seen[int(y), np.unique(f)] += 1
    share = np.maximum(seen.sum(0), 1) / len(toxic)
    beyond = (seen[1] - toxic.sum() * share) / np.sqrt(toxic.sum() * share * (1 - share) * (~toxic).mean() + 1e-9)
    return np.flatnonzero((beyond >= TELLING) & (seen[1] >= LEAST))


def train(examples: list[tuple[str, int]], share: float | None = None) -> Model | None:
    """Fit to texts with labels; share: how many of all labelled documents are toxic, if it is not the examples' own. None without both kinds."""
    parsed = [(s, y) for s, y in ((sentences(codes_of([t])), y) for t, y in examples) if len(s.first)]
    toxic = np.array([y == 1 for _, y in parsed], bool)
    if toxic.all() or not toxic.any():
        return None
    share = toxic.mean() if share is None else share
    known = telling([s.features for s, _ in parsed], toxic)
    at = np.full(1 << BITS, len(known), np.int32)
    at[known] = np.arange(len(known))
    words, lengths, n_sentences, kept = [], [], [], []  # of sentences with telling features, and of documents with such sentences
    for k, (s, _) in enumerate(parsed):
        places = at[s.features]
        some = np.logical_or.reduceat((places < len(known)).any(1), s.first)
        if some.any():
            length = np.diff(np.append(s.first, len(places)))
            words.append(places[np.repeat(some, length)])
            lengths.append(length[some])
            n_sentences.append(some.sum())
            kept.append(k)
    if not kept or toxic[kept].all() or not toxic[kept].any():
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    weight = np.where(toxic, share / toxic.sum(), (1 - share) / (~toxic).sum())[kept]
    toxic, places, words_of = toxic[kept], np.concatenate(words), np.concatenate(lengths)
    first_word, first = (np.cumsum(x) - x for x in (words_of, np.array(n_sentences)))
    # the bias that gives the mean document the share's chance
    bias = float(np.log(np.expm1(-np.log1p(-min(share, 0.99)) / np.mean(n_sentences))))
    w = np.zeros(len(known) + 2)  # the last two: of all other features, always 0, and the bias
    w[-1] = bias
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        z = w[-1] + np.add.reduceat(w[places].sum(1), first_word)
        _, dz = loss(z, first, toxic, weight)
        by_word = np.repeat(dz, words_of)
        gradient = np.zeros_like(w)
        for k in range(places.shape[1]):
            gradient += np.bincount(places[:, k], by_word, len(w))
        gradient += DECAY * w
        gradient[-2:] = 0, dz.sum()
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient**2
        w -= STEP * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[known] = w[:-2]
    return Model(weights, float(w[-1]))


def held_out(doc_id: str = "doc_id") -> Column:
    """The fifth of rows whose labels are not learned."""
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit to at most TOXIC and CLEAN labelled documents that are not held out, of at most LONGEST characters.

    Which ones, a CRC of doc_id decides, so reruns agree. Labels other than 0 and 1, labels without document and documents
    without words are left out; a document with several labels is an example of each. None without both kinds.
    """
    ids = docs.select(col(doc_id).alias("id")).distinct()
    draw = F.crc32(F.concat(F.lit("t"), F.col("id").cast("string")).cast("binary"))
    rows = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0))
    rows = rows.join(ids, "id", "left_semi").withColumn("draw", draw)
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    # twice as many as are wanted, or so, are sorted for it
    drawn = [rows.where((F.col("y") == y) & (F.col("draw") < int(min(1.0, 2 * most / counts[y]) * 2**32))).orderBy("draw", "id").limit(most) for y, most in ((1, TOXIC), (0, CLEAN))]
    chosen = F.broadcast(drawn[0].union(drawn[1]))  # no more rows than TOXIC + CLEAN
    passages = docs.select(col(doc_id).alias("id"), col(text).alias("text")).where(F.length("text") <= LONGEST).join(chosen, "id")
    found = passages.orderBy("draw", "id", "y", F.xxhash64("text"), "text").limit(TOXIC + CLEAN).select("text", "y").collect()
    return train([(r["text"], r["y"]) for r in found], counts[1] / (counts[0] + counts[1]))


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """A long text in pieces of whole sentences, each with its place; what a piece ends within comes again at the next one's start."""
    at, size = 0, WORK
    while at < len(text) or not at:
        piece = text[at : at + size]
        if at + size >= len(text):
            yield at, piece
            return
        found = sentences(codes_of([piece]))
        if len(found.start) > 1:
            cut = int(found.start[-1])
            yield at, piece[:cut]
            at, size = at + cut, WORK
        elif not len(found.start):
            at, size = at + len(piece), WORK
        else:
            size *= 2


def score(model: Model | None, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
    """Of each text its chance of being toxic, and its sentences: start, end, chance."""
    out: list[tuple[float, list[tuple[int, int, float]]]] = [(0.0, [])] * len(texts)
    if model is None:
        return out
    hidden = np.zeros(len(texts))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    held: list[tuple[int, int, str]] = []

    def work() -> None:
        if not held:
            return
        begin = np.cumsum([0, *(len(t) + 1 for _, _, t in held)])
        found = sentences(codes_of([t for _, _, t in held]))
        z = model.chances(found)
        which = np.searchsorted(begin, found.start, side="right") - 1
        np.add.at(hidden, np.array([i for i, _, _ in held])[which], softplus(z))
        for k, s, e, p in zip(which.tolist(), found.start.tolist(), found.end.tolist(), (0.5 * (1 + np.tanh(0.5 * z))).tolist(), strict=True):
            i, at, _ = held[k]
            shift = at - int(begin[k])
            spans[i].append((s + shift, e + shift, p))
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for at, piece in pieces(t.replace("\0", " ")) if t else ():
            held.append((i, at, piece))
            size += len(piece)
            if size >= WORK:
                work()
                size = 0
    work()
    return [(float(-np.expm1(-h)), s) for h, s in zip(hidden, spans, strict=True)]


#: Columns that toxicity() adds.
ADDED = ("score", "predicted", "offending", "worst")
SPAN = "struct<start: bigint, end: bigint, score: double>"


def toxicity(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Kept columns of docs with the chance that the whole text is toxic, predicted (1 from TOXIC_FROM on), the offending sentences and the worst one.

    A sentence goes from its first letter or digit to its last, in code points, the end exclusive; offending ones have a chance of TOXIC_FROM
    or more. Defined results: null, empty and wordless texts, and all texts if there was nothing to learn from, have score
    0, no offending sentence and no worst one; of equally bad sentences the first is the worst; a sentence of more than
    SENTENCE words is several; repeated rows get equal results; kept columns with the added names are replaced; very long
    texts are scored a piece at a time, with the same result.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    rows = docs.select(*map(col, kept), col(text).cast("string").alias("__text"))
    kinds = with_fields(rows.schema.fields[:-1], f"score double, predicted int, offending array<{SPAN}>, worst {SPAN}")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def named(s: tuple[int, int, float]) -> dict:
        return {"start": s[0], "end": s[1], "score": s[2]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(model, batch.column(len(kept)).to_pylist())
            scores = pa.array([s for s, _ in found], pa.float64())
            predicted = pa.array([int(s >= TOXIC_FROM) for s, _ in found], pa.int32())
            offending = pa.array([[named(x) for x in spans if x[2] >= TOXIC_FROM] for _, spans in found], pa.list_(span))
            worst = pa.array([named(max(spans, key=lambda x: x[2])) if spans else None for _, spans in found], span)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores, predicted, offending, worst], [*kept, *ADDED])

    return map_arrow(rows, run, kinds)


def offending(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each offending sentence: the kept columns with its start, end, score and the sentence itself; odd input as toxicity() defines it."""
    names = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[col(c).alias(c) for c in names] or [F.lit(0)]).alias("row"), col(text).alias("text"))
    found = toxicity(packed, model, keep=["row", "text"]).select("row", "text", F.explode("offending").alias("s"))
    added = [("start", F.col("s.start")), ("end", F.col("s.end")), ("score", F.col("s.score")), ("sentence", F.substring(F.col("text"), (F.col("s.start") + 1).cast("int"), (F.col("s.end") - F.col("s.start")).cast("int")))]
    return found.select(*[F.col("row").getField(c).alias(c) for c in names if c not in dict(added)], *[c.alias(n) for n, c in added])
