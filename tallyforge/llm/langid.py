"""Language identification: a linear-chain conditional random field labels each word of a text.

Features of a word are its character n-grams with its boundaries (two and three letters), its affixes (first and last
three letters) and itself (a lexicon). Feature weights and the transitions between the languages of neighbouring
words are learned together, also from passages in which languages are switched. Forward and backward sums give each
word's probability of each language; a text's language is the one with the largest share of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_arrow, small_batches, with_fields

#: Bounds of the training sample: passages of each language, their characters, languages (the commonest; rarer ones are not learned).
PASSAGES, PASSAGE, LANGUAGES = 400, 1500, 256
#: Hash tables of features: pairs, triples, affixes, words.
TABLES = (1 << 15, 1 << 17, 1 << 16, 1 << 17)
STARTS = np.concatenate([[0], np.cumsum(TABLES)]).astype(np.int64)
#: Characters whose words are labelled together, and whose features are worked out at once.
WORK, FEATURES = 3_000_000, 400_000
UNKNOWN = "und"

_letter: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter:
        _letter.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letter[0]


def _mix(x: np.ndarray, table: int) -> np.ndarray:
    """Place in one of the tables."""
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) & np.uint64(TABLES[table] - 1)).astype(np.int64) + STARTS[table]


@dataclass
class Words:
    """Words (runs of letters) of some text: features at each place of it, of each word, and where words lie."""

    pairs: np.ndarray
    triples: np.ndarray
    affixes: np.ndarray
    lexicon: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words_of(codes: np.ndarray) -> Words:
    """codes: lower-case code points, with a 0 before, and two after, what they hold."""
    a = np.where(_letters()[codes], codes, 0).astype(np.uint64)
    inside = a > 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    pairs, triples = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    before = a[:-1]
    pairs[1:] = _mix((before << np.uint64(21)) | a[1:], 0)
    second = np.where(a[1:-1] > 0, a[:-2], 0)
    triples[2:] = _mix((second << np.uint64(42)) | (a[1:-1] << np.uint64(21)) | a[2:], 1)
    triples[1] = _mix(a[1:2], 1)[0]
    lexicon = np.zeros(len(start), np.uint64)
    if len(start):
        power = _powers(int((end - start).max()))
        nth = np.arange(len(a)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(a)]])))
        lexicon = np.add.reduceat(np.where(inside, a * power[np.minimum(nth, len(power) - 1)], 0), start)
    last = np.maximum(end - 3, start)
    first3 = (a[start] << np.uint64(42)) | (np.where(start + 1 < end, a[start + 1], 0) << np.uint64(21)) | np.where(start + 2 < end, a[np.minimum(start + 2, len(a) - 1)], 0)
    last3 = (a[last] << np.uint64(42)) | (np.where(last + 1 < end, a[last + 1], 0) << np.uint64(21)) | np.where(last + 2 < end, a[np.minimum(last + 2, len(a) - 1)], 0)
    affixes = np.stack([_mix(first3 * np.uint64(3) + np.uint64(1), 2), _mix(last3 * np.uint64(3) + np.uint64(2), 2)])
    return Words(pairs, triples, affixes, _mix(lexicon, 3), start, end)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0xD6E8FEB86659FD93, np.uint64))


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts in lower case, apart from each other by zeros; where each text ends."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer(("\0" + "\0".join(low) + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum([len(t) + 1 for t in low]).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # language, feature
    moves: np.ndarray  # log weight of language -> next word's language
    begin: np.ndarray

    def scores(self, words: Words) -> np.ndarray:
        """Log weight of each language for each word."""
        out = np.empty((len(words.start), len(self.languages)))
        for k, w in enumerate(self.weights):
            sums = np.cumsum(w[words.pairs] + w[words.triples], dtype=np.float64)
            out[:, k] = sums[np.minimum(words.end, len(sums) - 1)] - sums[words.start - 1] + w[words.affixes].sum(0) + w[words.lexicon]
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple:
        """Forward-backward over all sequences at once: word probabilities (if kept), sums of them by sequence, of pairs (if kept), and of the largest of each word.

        scores: of all words, one sequence after another.
        """
        order = np.argsort(-lengths, kind="stable")
        ordered = lengths[order]
        live = len(lengths) - np.searchsorted(ordered[::-1], np.arange(int(ordered[0]) if len(ordered) else 0), side="right")
        first = (np.cumsum(lengths) - lengths)[order]
        at = np.concatenate([[0], np.cumsum(live)]).astype(np.int64)
        # words by (place in sequence, sequence)
        place = np.concatenate([first[:n] + t for t, n in enumerate(live)]) if len(live) else np.zeros(0, np.int64)
        x = np.exp(scores[place] - scores[place].max(1, keepdims=True)) if len(place) else np.zeros((0, len(self.languages)))
        moves, alpha = np.exp(self.moves), np.empty_like(x)
        for t, n in enumerate(live):
            a = x[at[t] : at[t + 1]] * (np.exp(self.begin) if t == 0 else alpha[at[t - 1] : at[t - 1] + n] @ moves)
            a /= a.sum(1, keepdims=True)
            alpha[at[t] : at[t + 1]] = a
        total, tops = np.zeros((len(lengths), x.shape[1])), np.zeros(len(lengths))
        pairs, prob = np.zeros_like(moves), np.empty_like(x) if keep else None
        beta = np.ones((0, x.shape[1]))
        for t in range(len(live) - 1, -1, -1):
            n, m = live[t], len(beta)
            b = np.ones((n, x.shape[1]))
            if m:
                ahead = x[at[t + 1] : at[t + 2]] * beta
                b[:m] = ahead @ moves.T
                if keep:
                    a = alpha[at[t] : at[t] + m]
                    norm = np.einsum("ni,ij,nj->n", a, moves, ahead)
                    pairs += moves * (a.T @ (ahead / norm[:, None]))
                b[:m] /= b[:m].max(1, keepdims=True)
            p = alpha[at[t] : at[t + 1]] * b
            p /= p.sum(1, keepdims=True)
            total[:n] += p
            tops[:n] += p.max(1)
            if keep:
                prob[at[t] : at[t + 1]] = p
            beta = b
        out, out_tops = np.empty_like(total), np.empty_like(tops)
        out[order], out_tops[order] = total, tops
        if keep:
            back = np.empty_like(prob)
            back[place] = prob
            prob = back
        return prob, out, pairs, out_tops


def train(passages: list[tuple[str, str]], *, seed: int = 11, epochs: int = 6) -> Model | None:
    """Fit to (text, language) passages; None if there are none with letters."""
    languages = sorted({lang for _, lang in passages})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    split = [(t.split(), languages.index(lang)) for t, lang in passages]
    split = [(w, k) for w, k in split if w]
    model = Model(languages, np.zeros((len(languages), STARTS[-1]), np.float32), np.zeros((len(languages),) * 2), np.zeros(len(languages)))
    if len(languages) == 1 or not split:
        return model if split else None
    grown, grown_moves = np.full_like(model.weights, 1e-6), np.full_like(model.moves, 1.0)
    for epoch in range(epochs):
        # half of the sequences are passages as they are, half are put together from pieces of several
        sequences: list[list[tuple[list[str], int]]] = []
        for words, k in split:
            at = int(rng.integers(0, max(1, len(words) - 60)))
            sequences.append([(words[at : at + 60], k)])
            mixed = []
            for _ in range(int(rng.integers(2, 5))):
                other, j = split[int(rng.integers(len(split)))]
                n = int(rng.integers(4, 20))
                at = int(rng.integers(0, max(1, len(other) - n)))
                mixed.append((other[at : at + n], j))
            sequences.append(mixed)
        for rows in np.array_split(rng.permutation(len(sequences)), max(1, len(sequences) // 64)):
            texts, gold = [], []
            for s in rows:
                for words, k in sequences[s]:
                    texts.append(" ".join(words))
                    gold.append(k)
            codes, ends = codes_of(texts)
            words = words_of(codes)
            owner = np.searchsorted(ends, words.start, side="right")
            sequence = np.repeat(np.arange(len(rows)), [len(sequences[s]) for s in rows])[owner]
            lengths = np.bincount(sequence, minlength=len(rows))
            if not len(owner):
                continue
            truth = np.array(gold)[owner]
            scores = model.scores(words)
            prob, _, pairs, _ = model.marginals(scores, lengths[lengths > 0], keep=True)
            slope = -prob
            slope[np.arange(len(truth)), truth] += 1
            near = sequence[1:] == sequence[:-1]
            seen = np.zeros_like(model.moves)
            np.add.at(seen, (truth[:-1][near], truth[1:][near]), 1.0)
            change = (seen - pairs) / len(rows) - 0.01 * model.moves
            grown_moves += change**2
            model.moves += 0.3 * change / np.sqrt(grown_moves)
            span = words.end - words.start + 1
            inner = np.repeat(words.start - (np.cumsum(span) - span), span) + np.arange(span.sum())
            of = np.repeat(np.arange(len(span)), span)
            features = np.concatenate([words.pairs[inner], words.triples[inner], words.affixes[0], words.affixes[1], words.lexicon])
            rank = np.concatenate([of, of, *[np.arange(len(span))] * 3])
            used = np.unique(features)
            for k in range(len(languages)):
                g = np.bincount(features, weights=slope[rank, k], minlength=STARTS[-1])[used]
                grown[k, used] += g**2
                model.weights[k, used] += (0.15 if epoch < epochs - 2 else 0.07) * g / np.sqrt(grown[k, used])
    return model


def label(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Language, share of words, and mean probability of each word's likeliest language, for each text."""
    languages, shares, sure = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is None:
        return languages, shares, sure
    batch: list[int] = []
    size, most = 0, WORK * 4 // max(4, len(model.languages))  # what is held is words x languages
    for i in range(len(texts) + 1):
        if batch and (i == len(texts) or size + len(texts[i] or "") > most):
            _label(model, texts, batch, languages, shares, sure)
            batch, size = [], 0
        if i < len(texts) and texts[i]:
            batch.append(i)
            size += len(texts[i])
    return languages, shares, sure


def _pieces(text: str) -> Iterator[str]:
    """A very long text in parts of about FEATURES characters, cut where no word is cut."""
    at = 0
    while len(text) - at > FEATURES:
        end = at + FEATURES
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _scored(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Scores of all words of the texts, one text after another, and how many words each has."""
    lengths, scores = np.zeros(len(texts), np.int64), [np.zeros((0, len(model.languages)))]
    held: list[tuple[int, str]] = []

    def work() -> None:
        codes, ends = codes_of([p for _, p in held])
        words = words_of(codes)
        scores.append(model.scores(words))
        of = np.bincount(np.searchsorted(ends, words.start, side="right"), minlength=len(held))
        np.add.at(lengths, [i for i, _ in held], of[: len(held)])
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        for piece in _pieces(text):
            if held and size + len(piece) > FEATURES:
                work()
                size = 0
            held.append((i, piece))
            size += len(piece)
    if held:
        work()
    return np.concatenate(scores), lengths


def _label(model: Model, texts: list[str | None], batch: list[int], languages: list[str], shares: list[float], sure: list[float]) -> None:
    scores, n = _scored(model, [texts[i] for i in batch])
    kept = np.flatnonzero(n)
    if not len(kept):
        return
    _, totals, _, tops = model.marginals(scores, n[kept])
    best = totals.argmax(1)
    for j, k, s, t in zip(kept.tolist(), best.tolist(), (totals[np.arange(len(kept)), best] / n[kept]).tolist(), (tops / n[kept]).tolist(), strict=True):
        languages[batch[j]], shares[batch[j]], sure[batch[j]] = model.languages[k], min(1.0, max(0.0, s)), min(1.0, max(0.0, t))


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Fit to labelled documents that are not held out: a passage of each of at most PASSAGES documents a language."""
    digits = F.concat(F.lit("s"), col(doc_id).cast("string"))
    rows = docs.select(
        col(text).alias("text"), col(lang).cast("string").alias("lang"), F.crc32(col(doc_id).cast("string").cast("binary")).alias("fold"), F.crc32(digits.cast("binary")).alias("draw")
    ).where("text IS NOT NULL AND lang IS NOT NULL AND fold % 4 <> 2")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    most = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, 1.5 * PASSAGES / n) * 2**32))])
    place = F.lit(1) + F.pmod(F.col("draw"), F.greatest(F.length("text") - PASSAGE, F.lit(1))).cast("int")
    drawn = rows.where(F.col("draw") < F.coalesce(F.element_at(most, F.col("lang")), F.lit(0))).select("lang", "draw", F.substring(F.col("text"), place, F.lit(PASSAGE)).alias("text"))
    found = sorted((r["draw"], r["lang"], r["text"]) for r in drawn.limit(3 * PASSAGES * len(counts)).collect())
    taken: dict[str, list[tuple[str, str]]] = {}
    for _, k, t in found:
        if len(taken.setdefault(k, [])) < PASSAGES:
            taken[k].append((t, k))
    return train([p for k in sorted(taken) for p in taken[k]])


def identify(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Kept columns of docs with the language of each whole text and its share of the words; a third name adds how sure the words are.

    Defined results: null, empty and letterless texts, and all texts if there was nothing to learn from, are "und"
    with score 0; with one language learned, every text with letters has it; ties go to the first language by name;
    repeated rows get equal results; kept columns with the added names are replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    rows = docs.select(*map(col, kept), col(text).alias("__text"))
    kinds = with_fields(rows.schema.fields[:-1], ", ".join(f"`{n}` {k}" for n, k in zip(names, ("string", "double", "double"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            lang, *numbers = label(model, batch.column(len(kept)).to_pylist())[: len(names)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), *(pa.array(x, pa.float64()) for x in numbers)], [*kept, *names])

    return map_arrow(rows, run, kinds)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to some MB, as the steps along the longest text cost the same for few texts and for many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) > 6_000_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
