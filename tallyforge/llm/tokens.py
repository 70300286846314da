"""Token ids as binary shards, coded by a static range asymmetric numeral system.

A shard holds the ids of consecutive documents. One table of symbol frequencies serves all its blocks; a block of
BLOCK ids is coded on its own, by LANES coders that take turns (id i goes to lane i mod LANES). Every CHECKPOINT
steps a block keeps its coders' states and its place in the stream, so that decoding can start there, and it has a
CRC-32 of its ids. All blocks of a shard are coded and decoded side by side, one NumPy operation for all lanes.

Layout of a shard, little-endian: MAGIC, then nine unsigned 64-bit numbers (ids, documents, blocks, and the lengths
of the six sections), then the sections: document table, symbol table (both zstandard), words in each block's
stream, checksums of blocks, checkpoints, streams.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, small_batches, written

MAGIC = b"TFRANS01"
#: Bits of a probability; ids in a block; coders in a block; steps between checkpoints.
BITS, BLOCK, LANES, CHECKPOINT = 20, 65536, 64, 256
LOW = np.uint64(1 << 31)
#: A point or comma that the tokenizer may join to what stands before or after it.
_run = re.compile(r"[.,](?:[^\w\s]|_|(?<=[^\w\s][.,])|(?<=_[.,]))")
#: One that stands alone after a letter or digit at the end of a word.
_end = re.compile(r"(?<=[^\W_])([.,])(?=\s|$)")
_letters = re.compile(r"[^\W\d_]+|[\W\d_]+")
#: Ids after which a shard is closed: bounds what a worker holds.
SHARD = 1 << 21


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur, and their frequencies scaled to a sum of 2 ** BITS, none below 1."""
    counts = np.bincount(ids)  # as long as the vocabulary at most
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    scaled = np.maximum(1, (counts.astype(np.float64) * ((1 << BITS) - len(symbols)) / max(1, counts.sum())).astype(np.int64))
    if len(scaled):
        scaled[np.argmax(scaled)] += (1 << BITS) - scaled.sum()
    return symbols.astype(np.uint32), scaled.astype(np.uint64)


def _steps(n: int) -> np.ndarray:
    """Steps of each block."""
    full, rest = divmod(n, BLOCK)
    return np.array([BLOCK // LANES] * full + [-(-rest // LANES)] * (rest > 0), dtype=np.int64)


def encode(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A shard: ids of len(lengths) documents, one after another."""
    ids = np.ascontiguousarray(ids, dtype=np.uint32)
    n, steps = len(ids), _steps(len(ids))
    blocks = len(steps)
    symbols, freq = _frequencies(ids)
    first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(freq)]).astype(np.uint64)
    # ids as (step, block, lane); what is missing in the last step is filled with the commonest symbol
    grid = np.full(blocks * BLOCK, np.argmax(freq) if len(freq) else 0, dtype=np.uint32)
    places = np.zeros(int(symbols[-1]) + 1 if len(symbols) else 1, np.uint32)
    places[symbols] = np.arange(len(symbols))
    grid[:n] = places[ids]
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2)).reshape(BLOCK // LANES, -1)
    state = np.full(blocks * LANES, LOW, dtype=np.uint64)
    words, lanes, sent = [], [], np.zeros(blocks, np.int64)
    kept: list[tuple[int, np.ndarray, np.ndarray]] = []
    counted = 0
    whole, shift, word = np.uint64(1 << BITS), np.uint64(63 - BITS), np.uint64(32)
    for t in range(int(steps.max(initial=0)) - 1, -1, -1):
        live = LANES * (blocks if t < steps[-1] else blocks - 1)  # only the last block can be shorter
        s = grid[t, :live]
        f, x = freq[s], state[:live]
        over = np.flatnonzero(x >= f << shift)
        if len(over):
            full = x[over]
            words.append(full.astype(np.uint32))
            lanes.append(over)
            x[over] = full >> word
        x += (x // f) * (whole - f) + first[s]
        if t % CHECKPOINT == 0:
            if len(lanes) > counted:
                sent += np.bincount(np.concatenate(lanes[counted:]) // LANES, minlength=blocks)
                counted = len(lanes)
            kept.append((t, state.copy(), sent.copy()))
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    owner = np.concatenate(lanes[::-1]) // LANES if lanes else np.zeros(0, np.int64)
    stream = stream[np.argsort(owner.astype(np.uint16), kind="stable")]
    points = b"".join(
        np.int64(sent[b] - at[b]).tobytes() + x[b * LANES : (b + 1) * LANES].tobytes() for b in range(blocks) for t, x, at in reversed(kept) if t < steps[b]
    )
    checks = np.array([zlib.crc32(ids[b * BLOCK : (b + 1) * BLOCK].tobytes()) for b in range(blocks)], np.uint32)
    pack = zstandard.ZstdCompressor(level=3).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = known.tobytes() + np.array([d or 0 for d in doc_ids], np.int64).tobytes() + np.array(lengths, np.int64).tobytes()
    sections = [pack(table), pack(symbols.tobytes() + freq.astype(np.uint32).tobytes()), sent.tobytes(), checks.tobytes(), points, stream.tobytes()]
    return MAGIC + struct.pack("<9Q", n, len(lengths), blocks, *map(len, sections)) + b"".join(sections)


class Shard:
    """Reads a shard; blocks can be decoded on their own, from any of their checkpoints."""

    def __init__(self, raw: bytes) -> None:
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.n, docs, self.blocks, *sizes = struct.unpack_from("<9Q", raw, len(MAGIC))
        at, parts = len(MAGIC) + 72, []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += size
        if at != len(raw):
            raise ValueError("a shard of the wrong length")
        unpack = zstandard.ZstdDecompressor().decompress
        table = unpack(parts[0])
        known = np.frombuffer(table, np.uint8, docs)
        ids, self.lengths = np.frombuffer(table, np.int64, docs, docs), np.frombuffer(table, np.int64, docs, 9 * docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        table = unpack(parts[1])
        self.symbols, self.freq = np.split(np.frombuffer(table, np.uint32), 2)
        self.first = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq, dtype=np.uint64)]).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(self.symbols), dtype=np.uint16 if len(self.symbols) <= 1 << 16 else np.uint32), self.freq)
        self.words = np.frombuffer(parts[2], np.int64)
        self.checks = np.frombuffer(parts[3], np.uint32)
        self.steps = _steps(self.n)
        points = np.frombuffer(parts[4], np.dtype([("at", "<i8"), ("state", "<u8", (LANES,))]))
        self.points = np.split(points, np.cumsum(-(-self.steps // CHECKPOINT))[:-1]) if self.blocks else []
        self.starts = np.concatenate([[0], np.cumsum(self.words)]).astype(np.int64)
        self.stream = np.frombuffer(parts[5], np.uint32)

    def _run(self, chosen: list[int], begin: int, most: int | None = None) -> np.ndarray:
        """Indices of symbols of the chosen blocks, longest first, from step begin (at a checkpoint) on, most steps at most: (block, step, lane)."""
        points = [self.points[b][begin // CHECKPOINT] for b in chosen]
        state = np.array([p["state"] for p in points], np.uint64).reshape(-1)
        at = np.array([self.starts[b] + p["at"] for b, p in zip(chosen, points, strict=True)], np.int64)
        steps = self.steps[chosen] if most is None else np.minimum(self.steps[chosen], begin + most)
        out = np.zeros((int(steps.max()) - begin, len(chosen) * LANES), np.uint32)
        freq, mask, bits, word = self.freq.astype(np.uint64), np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32)
        for t in range(begin, int(steps.max())):
            live = int((steps > t).sum())
            x = state[: live * LANES]
            slot = x & mask
            s = self.slots[slot]
            out[t - begin, : len(s)] = s
            x = freq[s] * (x >> bits) + slot - self.first[s]
            low = np.flatnonzero(x < LOW)
            if len(low):
                block = low // LANES
                count = np.bincount(block, minlength=live)
                place = (at[:live] - np.cumsum(count) + count)[block] + np.arange(len(low))
                x[low] = (x[low] << word) | self.stream[place]
                at[:live] += count
            state[: live * LANES] = x
        return out.reshape(len(out), len(chosen), LANES).transpose(1, 0, 2)

    def block(self, b: int, point: int = 0, points: int | None = None) -> np.ndarray:
        """Ids of one block from one of its checkpoints on, to its end or over so many checkpoints."""
        found = self.symbols[self._run([b], point * CHECKPOINT, None if points is None else points * CHECKPOINT)[0].reshape(-1)]
        return found[: min(BLOCK, self.n - b * BLOCK) - point * CHECKPOINT * LANES]

    def ids(self) -> np.ndarray:
        """All ids, every block checked."""
        if not self.blocks:
            return np.zeros(0, np.uint32)
        found = self.symbols[self._run(list(range(self.blocks)), 0).reshape(-1)[: self.n]]
        for b in range(self.blocks):
            if zlib.crc32(found[b * BLOCK : (b + 1) * BLOCK].tobytes()) != self.checks[b]:
                raise ValueError(f"block {b} is damaged")
        return found


def _gaps(ids: list) -> list[int]:
    """Places of None."""
    out, k = [], -1
    try:
        while True:
            out.append(k := ids.index(None, k + 1))
    except ValueError:
        return out


class Encoder:
    """Ids of whole texts, by way of the ids of their words where no token of the tokenizer crosses a space or line feed.

    That is probed; a tokenizer that it does not hold for (one whose tokens begin with a space, say) encodes whole texts.
    Where the tokenizer treats them alike, words are looked up in lower case, and a point or comma after letters or
    digits as a word of its own; a text for which either might change an id is looked up as it is. One text of CHECKED,
    chosen by its checksum, is encoded directly as well, and a difference is an error.
    """

    #: One text of so many is checked against direct encoding.
    CHECKED = 1024

    #: Words of a generation of known ones; the words that the last two generations met are kept.
    MOST = 350_000
    #: Texts that are looked up together: their words stay in the processor's cache.
    TEXTS = 16
    #: A mark that is a token of its own between words that are encoded together.
    MARK = "\x01"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        probes = ("a", "Word", "word.", "don't", "3.14,", "\u00e9t\u00e9", "\u6f22\u5b57", "$$x", "(y)", "_z", "<b>", "#", "A-B")
        gaps = (" ", "\n", "  ", " \n ", "\n\n")
        self.apart = all(ids(f"{a}{gap}{b}") == ids(a) + ids(b) for gap in gaps for a in probes for b in probes)
        self.apart &= all(ids(gap) == [] and ids(f"{gap}{a}{gap}") == ids(a) for gap in gaps for a in probes)
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.marks[ids(self.MARK)] = True
        letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
        self.lowers = all(ids(c) == ids(c.lower()) for c in letters)
        self.lean, self.last = self._leaner()
        self.runs = ids("ab$$1c--,D") == ids("ab") + ids("$$1") + ids("c") + ids("--,") + ids("D")
        self.splits = all(ids(f"{w}{c}") == ids(f"{w} {c}") for c in ".," for w in ("word", "3", "\u00e9"))

    def _leaner(self) -> tuple:
        """The same model without normaliser and splitter, for words that neither changes, and which ids end a word; or nothing."""
        from tokenizers import Tokenizer, pre_tokenizers

        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix or not self.lowers:
            return None, None
        lean = Tokenizer.from_str(self.tokenizer.to_str())
        lean.normalizer = lean.pre_tokenizer = None
        last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        # what the splitter makes of each byte: words go to the model in these letters
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {}
        for c in map(chr, range(0x800)):
            shown = level.pre_tokenize_str(c)[0][0]
            self.letters.update(zip(c.encode(), shown, strict=True))
        self.letters.update((b, level.pre_tokenize_str(chr(0x10000 * (b - 0xF0) + 0x10000))[0][0][0] if b >= 0xF0 else level.pre_tokenize_str(chr(max(0x800, (b - 0xE0) << 12)))[0][0][0]) for b in range(0xE0, 0xF5))
        probe = ["word", "caf\u00e9", "\u00df\u00fc\u00f1", "\u0434\u0430", "\u6f22\u5b57", "supercalifragilistic"]
        same = all(lean.encode([self._shown(w)], is_pretokenized=True, add_special_tokens=False).ids == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)
        return (lean, last) if same else (None, None)

    def _shown(self, word: str) -> str:
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)

    def _words(self, text: str) -> list[str]:
        plain = text.isascii()  # what is done to it cannot depend on what letters become
        if self.lowers and "<|" not in text:
            if plain:
                text = text.lower()
            elif "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low := text.lower()):
                text, plain = low, True
        if self.splits and plain:
            text = _end.sub(r" \1", text) if _run.search(text) else text.replace(".", " .").replace(",", " ,")
        return text.replace("\n", " ").split(" ")

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of unknown words. One of letters and other characters is put together from its runs of either, as the tokenizer splits there."""
        if not self.lean or not self.runs:
            return self._encode_each(words)
        runs = {}
        for w in words:
            if not w.isalpha() and w == w.lower() and "'" not in w and "<|" not in w and self.MARK not in w and (w.isascii() or unicodedata.is_normalized("NFC", w)):
                found = _letters.findall(w)
                if len(found) > 1:
                    runs[w] = found
        if not runs:
            return self._encode_each(words)
        known = self.known
        parts = {r for found in runs.values() for r in found}
        single = {w for w in words if w not in runs} | {r for r in parts if r not in known}
        got = self._encode_each(list(single))
        got.update((r, known[r]) for r in parts if r not in got)
        got.update((w, b"".join([got[r] for r in found])) for w, found in runs.items())
        return got

    def _encode_each(self, words: list[str]) -> dict[str, bytes]:
        """Many in one call: most of the cost of encoding a word alone is the call."""
        got: dict[str, bytes] = {}

        def cut(part: list[str], ids: list[int], marks: np.ndarray, skip: int) -> None:
            flat = np.array(ids, self.kind)
            width, raw, begin = flat.itemsize, flat.tobytes(), 0
            cuts = [*np.flatnonzero(marks[flat]).tolist(), *([len(flat)] if skip else [])]
            if part and len(cuts) != len(part):
                raise ValueError("ids of words that were encoded together cannot be told apart")
            for w, end in zip(part, cuts):  # noqa: B905  (no words, one cut)
                got[w] = raw[begin * width : (end + 1 - skip) * width]
                begin = end + 1

        # letters only, as the tokenizer would leave them: the model alone does
        plain = [w for w in words if w.isalpha() and w.islower() and w == w.lower() and (w.isascii() or unicodedata.is_normalized("NFC", w))] if self.lean else []
        for at in range(0, len(plain), 4096):
            part = plain[at : at + 4096]
            cut(part, self.lean.encode_batch_fast([list(map(self._shown, part))], is_pretokenized=True, add_special_tokens=False)[0].ids, self.last, 0)
        rest = [w for w in words if w not in got and self.MARK not in w]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            cut(part, self.tokenizer.encode_batch_fast([f" {self.MARK} ".join(part)], add_special_tokens=False)[0].ids, self.marks, 1)
        got.update((w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.kind).tobytes()) for w in words if self.MARK in w)
        return got

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as unsigned 16-bit integers, or 32-bit where the vocabulary needs them."""
        some = self._some if self.apart else self.direct
        out = [x for at in range(0, len(texts), self.TEXTS) for x in some(texts[at : at + self.TEXTS])]
        if self.apart:
            chosen = [i for i, t in enumerate(texts) if zlib.crc32(t[:256].encode("utf-8", "surrogatepass")) % self.CHECKED == 0]
            if any(out[i] != x for i, x in zip(chosen, self.direct([texts[i] for i in chosen]), strict=True)):
                raise ValueError("ids by words differ from those of the whole text")
        return out

    def direct(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as the tokenizer gives them for the whole text."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _some(self, texts: list[str]) -> list[bytes]:
        known, older = self.known, self.older
        split = [self._words(t) for t in texts]
        found = [list(map(known.get, words)) for words in split]
        gaps = [(words, ids, _gaps(ids)) for words, ids in zip(split, found, strict=True) if None in ids]
        missing = {words[k] for words, _, where in gaps for k in where}
        if missing:
            got = {w: older[w] for w in missing if w in older}
            got.update(self._encode([w for w in missing if w not in got]))
            for words, ids, where in gaps:
                for k in where:
                    ids[k] = got[words[k]]
            known.update((w, x) for w, x in got.items() if len(w) <= 64)
            if len(known) > self.MOST:
                self.known, self.older = {}, known
        return list(map(b"".join, found))

    @property
    def kind(self) -> type:
        return np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One for each worker and tokenizer. name: of a public tokenizer, or a path that every executor has."""
    if name not in _encoders:
        if os.path.isabs(name):
            path = name
        else:
            import public_tokenizers

            path = public_tokenizers.path(name)
        _encoders[name] = Encoder(path)
    return _encoders[name]


#: What a folder of shards holds: Parquet rows, of which payload is a shard in the layout above; part and shard give their order.
SHARDS = "part long, shard long, n_ids long, payload binary"


def open_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards that write_shards() wrote to a folder."""
    return spark.read.schema(SHARDS).parquet(path)


def write_shards(docs: DataFrame, *, tokenizer: str, path: str | None = None, end_id: int | None = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts and write shards in ascending order of doc_id; the shards as read back: part, shard, n_ids, payload.

    path: the folder to write them to, which must not hold any yet; without it one of its own in the shared folder. The
    shards are rows of Parquet files (see SHARDS), so that Spark commits each of them once, whatever executors are lost,
    and any store that Spark writes to will do. tokenizer: any file of the tokenizers library. Defined results: a null text is empty and gives
    only end_id; null doc_ids come first; rows with one doc_id follow each other in an order fixed by their texts;
    an empty table gives no shards; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, shard = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], coder.kind).tobytes()
        ids: list[int | None] = []
        coded: list[bytes] = []
        size, width = 0, np.dtype(coder.kind).itemsize

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(coded), coder.kind)
            payload = encode(flat, ids, [len(c) // width for c in coded])
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([shard], pa.int64()), pa.array([len(flat)], pa.int64()), pa.array([payload], pa.binary())],
                ["part", "shard", "n_ids", "payload"],
            )

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for key, raw in zip(keys, coder(texts), strict=True):
                ids.append(key)
                coded.append(raw + end)
                size += len(coded[-1]) // width
                if size >= SHARD:
                    yield close()
                    ids, coded, size, shard = [], [], 0, shard + 1
        if ids:
            yield close()

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(run, SHARDS)
    if path is None:
        return written(made, "token-shards")
    made.write.parquet(path)
    return open_shards(spark, path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shard = Shard(payload)
            flat = shard.ids()
            ends = np.cumsum(shard.lengths)
            raw = memoryview(flat.tobytes())
            begins = ends - shard.lengths
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shard.doc_ids, pa.int64()),
                    pa.array(begins + start),
                    pa.array(shard.lengths),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_blocks(shards: DataFrame) -> DataFrame:
    """part, shard, block, point, ids: what is between two checkpoints of a block, each decoded from its own checkpoint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "shard", "block", "point", "ids"]
        for batch in batches:
            for part, number, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(payload)
                for b in range(shard.blocks):
                    for point in range(len(shard.points[b])):
                        found = shard.block(b, point, 1).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([b], pa.int32()), pa.array([point], pa.int32()), pa.array([found], pa.list_(pa.int64()))], names)

    return shards.select("part", "shard", "payload").mapInArrow(run, "part long, shard long, block int, point int, ids array<long>")


def read_index(shards: DataFrame) -> DataFrame:
    """Decode all shards: doc_id, start (ids of all documents before it), n_tokens and the CRC-32 of its ids.

    Shards are decoded side by side, each with all its blocks at once; a damaged one is an error; no shards, no rows.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each written part
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", "n_ids").withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(totals, "part")
    starts = starts.select("part", "shard", (F.col("base") + F.col("inner")).alias("start"))
    located = shards.join(F.broadcast(starts) if starts.limit(200_001).count() <= 200_000 else starts, ["part", "shard"])
    return located.select("start", "payload").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
