"""Best-fit packing into sequences of several permitted lengths.

The plan is made on the histogram of piece lengths, which has at most as many entries as the largest sequence has
words, however many documents there are. Bins are filled largest piece first, each next piece the one that leaves the
least room (best fit). All permitted sizes are tried for a new bin and the one of least cost for each word it holds is
opened; as the histogram says how often the same filling can be repeated, one step plans all those bins at once. Last,
every bin is cut down to the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, col, map_arrow, plain_columns, ranked, small_batches, with_fields, written

#: Permitted sequence lengths, in words and end marks.
SIZES = (256, 512, 1024, 2048, 4096)
_word = re.compile(WORD)


@dataclass(frozen=True)
class Pattern:
    """bins bins of one size, all with pieces of these lengths, in this order."""

    size: int
    lengths: tuple[int, ...]
    bins: int


def plan(histogram: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = float) -> list[Pattern]:
    """Patterns that hold every piece of the histogram (length: pieces) exactly once."""
    sizes = tuple(sorted(sizes))
    if any(not 0 < n <= sizes[-1] for n in histogram):
        raise ValueError("a piece is longer than every permitted size")
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    out: list[Pattern] = []

    def fill(room: int) -> list[int]:
        used: dict[int, int] = {}
        filling, hi = [], len(lengths)
        while (k := bisect_right(lengths, room, 0, hi)) > 0:
            n = lengths[k - 1]
            take = min(left[n] - used.get(n, 0), room // n)
            if take:
                filling += [n] * take
                used[n] = used.get(n, 0) + take
                room -= take * n
            hi = k - 1 if take == 0 or room < n or used[n] == left[n] else k
        return filling

    while lengths:
        best = None
        for size in sizes:
            if size >= lengths[-1]:
                filling = fill(size)
                held = sum(filling)
                fits = next(s for s in sizes if s >= held)  # what it will be cut down to
                rate = (cost(fits) / held, -fits)
                if best is None or rate < best[0]:
                    best = (rate, fits, filling)
        _, size, filling = best
        times = min(left[n] // filling.count(n) for n in set(filling))
        out.append(Pattern(size, tuple(filling), times))
        for n in filling:
            left[n] -= times
        lengths = [n for n in lengths if left[n] > 0]
    return out


def _cut(text: str, largest: int) -> list[tuple[int, int, int, str]]:
    """Pieces of a text with an end mark: number, first word, length with the mark, words; then the piece itself."""
    if len(text) < 2 * largest:
        n = len(_word.findall(text))
        return [(0, 0, n + 1, text)] if n < largest else _cut_words(text, largest)
    return _cut_words(text, largest)


def _cut_words(text: str, largest: int) -> list[tuple[int, int, int, str]]:
    starts = [m.start() for m in _word.finditer(text)]
    total = len(starts) + 1  # the end mark
    if total <= largest:
        return [(0, 0, total, text)]
    begins = range(0, total, largest)
    at = [0, *(starts[b] if b < len(starts) else len(text) for b in begins[1:]), len(text)]
    return [(k, b, min(largest, total - b), text[at[k] : at[k + 1]]) for k, b in enumerate(begins)]


def pieces(docs: DataFrame, *, largest: int, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, extra: list[str] | None = None) -> DataFrame:
    """doc_id, extra columns, piece, start (first word), length (with the document's end mark), text if asked for."""
    small_batches(docs.sparkSession)
    extra = [c for c in extra or [] if c not in ("doc_id", "piece", "start", "length", "text", doc_id, text)]
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), *map(col, extra))
    fields = rows.schema.fields
    schema = with_fields([fields[0], *fields[2:]], "piece int, start long, length int" + ", text string" * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cut = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                found = _cut(t or "", largest)
                owner += [i] * len(found)
                cut += found
            index = pa.array(owner, pa.int32())
            new = list(zip(*cut, strict=True)) or [[]] * 4
            columns = [batch.column(0).take(index), *(batch.column(2 + k).take(index) for k in range(len(extra)))]
            columns += [pa.array(new[0], pa.int32()), pa.array(new[1], pa.int64()), pa.array(new[2], pa.int32())]
            if with_text:
                columns.append(pa.array(new[3], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *extra, "piece", "start", "length"] + ["text"] * with_text)

    return map_arrow(rows, run, schema)


def pack(docs: DataFrame, *, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = float, with_text: bool = False, **columns) -> DataFrame:
    """Every piece of every document with its bin: bin_id, bin_size, bin_start (its place in the bin), besides pieces().

    Defined results: a null or empty text is a piece of its end mark alone; a text of more words than the largest size
    is cut there, and its pieces cover it; ties are broken by doc_id, then piece, then a hash of the row; repeated rows
    are pieces of their own; no rows, no bins.
    """
    cut = pieces(docs, largest=max(sizes), with_text=with_text, **columns)
    plain = written(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in plain.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most max(sizes) rows
    patterns = plan(histogram, sizes, cost)
    # for each length: up to which rank a pattern's slots go, and what its slots are
    tables: dict[int, list[tuple[int, int, int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first_bin = 0
    for p in patterns:
        at = 0
        for n in sorted(set(p.lengths), reverse=True):
            slots = p.lengths.count(n)
            begin = seen.get(n, 0)
            tables.setdefault(n, []).append((begin, slots, first_bin, p.size, at, n))
            seen[n] = begin + slots * p.bins
            at += slots * n
        first_bin += p.bins
    arrays = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in tables.items()}
    names = plain.columns
    place = names.index("length")
    total = sum(histogram.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(place).to_numpy(zero_copy_only=False)
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False) - 1
            out = np.zeros((3, len(length)), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                begin, slots, base, size, at, width = arrays[int(n)]
                k = np.searchsorted(begin, rank[mine], side="right") - 1
                nth, slot = np.divmod(rank[mine] - begin[k], slots[k])
                out[:, mine] = base[k] + nth, size[k], at[k] + slot * width[k]
            added = [pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + added, [*names, "bin_id", "bin_size", "bin_start"])

    order = [F.col("doc_id"), F.col("piece"), F.col("start"), F.xxhash64(*map(col, plain_columns(plain)))]
    numbered = ranked(plain, ["length"], "doc_id", order, total, "pack_rank").select(*map(col, plain.columns), F.col("pack_rank").cast("long"))
    return map_arrow(numbered, run, with_fields(plain.schema.fields, "bin_id long, bin_size int, bin_start int"))
