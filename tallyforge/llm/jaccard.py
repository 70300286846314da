"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles; two link when 100 * common >= percent * all. A token that few
documents hold is light, one that many hold is heavy; in the one order for all sets the light ones come first, the
heavy ones by rising document frequency. Of a set of n tokens at most tau = n - ceil(percent * n / 100) can be missing
in a set that it links with. Its prefix is therefore extended along the order until tau + 1 of its tokens are
*covered*: a light token covers itself, and of c heavy tokens of one class c - 1 are covered, because whichever tau
tokens are missing then leave a light token, or two heavy tokens of one class. So a light token of the prefix is
indexed by itself and a heavy one only in combination with each other of its class in the prefix: two sets that link
share an entry, while a token that a great many documents hold brings nobody together alone. Classes of heavy tokens
are fixed by hash, their number by the power of two that a set's size lies in (a set is indexed for each power that a
partner's size can lie in), so that a prefix has a number of combinations in proportion to its size.

Entries of light tokens are short lists, whose pairs are held against a bound from 512 parity bits of each set (bits
that differ count tokens that differ); an entry of heavy tokens joins its sets to one of them. Candidates that this
connects form families. A family's whole sets are dealt into bands of sizes that can link with the same or the next
band alone, and into blocks; a spanning forest of the links within each block is kept. Between blocks at first one set
stands for each class that has grown within a block, so that a large group of near copies becomes one class at a cost
in proportion to it; then only the sets outside a family's largest class are held against the blocks that they may link
with. So neither an entry's sets nor the links of a large group ever meet in one task. Texts with equal sets count as
one from the beginning.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, if_small, plain_columns, remove, small_batches, written
from .graph import components

#: A token of more documents is heavy; most heavy tokens (the most frequent, sent to all executors); sets that a list of pairs may have.
LIGHT, HEAVY, LIST = 16, 1 << 20, 64
#: Sets and tokens of a block; sets of a class within a block from which on one stands for it.
BLOCK_SETS, BLOCK_TOKENS, CLASS = 1024, 2_000_000, 8
#: Sizes from which on heavy tokens are combined; below, every token is indexed by itself.
COMBINED = 5
#: Tokens that a task counts at once; bytes of text that are hashed at once; rows of the index that a task pairs at once.
COUNTED, PIECE, LISTED = 1_000_000, 300_000, 1_000_000
#: Ranges of tokens, of which a task counts one after another, unless there are more partitions.
RANGES = 4096

_space = re.compile(rb"[\t-\r ]")

_gap = np.zeros(256, bool)
_gap[[9, 10, 11, 12, 13, 32]] = True
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    codes = np.frombuffer(b"\n" + raw + b"\n", np.uint8)
    inside = ~_gap[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start
    size = end - start
    power = np.cumprod(np.full(int(size.max()), _K[3], np.uint64))
    nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    terms = (codes[inside].astype(np.uint64) + np.uint64(1)) * power[nth]
    return _mix(np.add.reduceat(terms, np.cumsum(size) - size)), start - 1


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A very long text in parts of about PIECE bytes, cut between words."""
    at = 0
    while len(raw) - at > PIECE:
        m = _space.search(raw, at + PIECE)
        end = m.start() if m else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    hashes, owners, held = [], [], []

    def work() -> None:
        ends = np.cumsum([len(r) + 1 for _, r in held])
        word, start = _word_hashes(b"\n".join(r for _, r in held))
        hashes.append(word)
        owners.append(np.array([i for i, _ in held])[np.searchsorted(ends, start, side="right")])
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for raw in _pieces((t or "").encode("utf-8", "surrogatepass").lower()):  # A-Z only
            if held and size + len(raw) > PIECE:
                work()
                size = 0
            held.append((i, raw))
            size += len(raw)
    if held:
        work()
    word, owner = np.concatenate(hashes or [np.zeros(0, np.uint64)]), np.concatenate(owners or [np.zeros(0, np.int64)])
    n = max(0, len(word) - words + 1)
    total = np.zeros(n, np.uint64)
    for k in range(words):
        total = _mix(total * _K[0] + word[k : n + k])
    whole = owner[:n] == owner[words - 1 : n + words - 1]
    total, of = total[whole], owner[:n][whole]
    cuts = np.searchsorted(of, np.arange(len(texts) + 1))
    counts = np.bincount(owner, minlength=len(texts))
    begins = np.cumsum(counts) - counts
    out = []
    for i in range(len(texts)):
        if counts[i] >= words:
            s = np.sort(total[cuts[i] : cuts[i + 1]])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif counts[i]:
            h = np.array([counts[i]], np.uint64)
            for w in word[begins[i] : begins[i] + counts[i]]:
                h = _mix(h * _K[1] + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two numbers of 64 bits for a set."""
    a, b = int(_mix(s).sum(dtype=np.uint64)), int(_mix(s ^ _K[2]).sum(dtype=np.uint64))
    return a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)


def parity(s: np.ndarray, bits: int = 512) -> bytes:
    """For each bit whether an odd number of tokens falls on it. Sets differ in at least as many tokens as these differ in bits."""
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes()


#: Of sets of more tokens WIDE bits are kept besides, as 512 bits say little of them.
LARGE, WIDE = 1024, 8192


#: Columns of the parity bits.
BITS = [f"p{k}" for k in range(8)]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- document frequencies

# A token counts by its highest 48 bits, of which a sorted list needs 4 bytes each; with its count it fits 64 bits.


def counted(held: list[np.ndarray], ranges: int) -> Iterator[tuple[int, bytes]]:
    """Tokens of some sets with their counts, packed by range: sorted, as differences, and the counts that are not 1."""
    tokens = np.sort(np.concatenate(held) >> np.uint64(16))
    new = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    value, count = tokens[new], np.diff(np.concatenate([new, [len(tokens)]]))
    bounds = np.array([(r << 48) // ranges for r in range(1, ranges)], np.uint64)
    cuts = np.searchsorted(value, bounds)
    for r, (v, c) in enumerate(zip(np.split(value, cuts), np.split(count, cuts), strict=True)):
        if len(v):
            step = np.diff(v)
            wide = bool(len(step)) and int(step.max()) >= 1 << 32
            more = np.flatnonzero(c > 1)
            head = np.array([len(v), wide, len(more), v[0]], np.uint64)
            yield r, head.tobytes() + step.astype(np.uint64 if wide else np.uint32).tobytes() + more.astype(np.uint32).tobytes() + c[more].astype(np.uint32).tobytes()


def _counting(words: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            out = list(counted(held, ranges))
            return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["range", "tokens"])

        for batch in batches:
            sets = shingle_sets(batch.column(0).to_pylist(), words)
            held += [s for s in sets if len(s)]
            size += sum(map(len, sets))
            if size > COUNTED:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return run


def _unpack(raw: bytes) -> np.ndarray:
    """Tokens and counts of one list as token << 16 | count, a count beyond 16 bits in several numbers."""
    n, wide, more, first = (int(x) for x in np.frombuffer(raw, np.uint64, 4))
    step = np.frombuffer(raw, np.uint64 if wide else np.uint32, n - 1, 32)
    at = 32 + step.nbytes
    value = np.cumsum(np.concatenate([[np.uint64(first)], step.astype(np.uint64)]), dtype=np.uint64)
    place, extra = np.frombuffer(raw, np.uint32, more, at), np.frombuffer(raw, np.uint32, more, at + 4 * more).astype(np.int64) - 1
    out = [(value << np.uint64(16)) | np.uint64(1)]
    while extra.any():
        part = np.minimum(extra, 0xFFFF)
        out.append((value[place[part > 0]] << np.uint64(16)) | part[part > 0].astype(np.uint64))
        extra = extra - part
    return np.concatenate(out)


def _heavy(least: int):
    """Tokens of more than least documents. Rows come sorted by range; a task holds those of one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        current = None

        def totals() -> pa.RecordBatch:
            both = np.concatenate(held)
            both.sort()
            first = np.flatnonzero(np.concatenate([[True], both[1:] >> np.uint64(16) != both[:-1] >> np.uint64(16)]))
            total = np.add.reduceat((both & np.uint64(0xFFFF)).astype(np.int64), first)
            kept = total > least
            return pa.RecordBatch.from_arrays([pa.array(_signed(both[first][kept] >> np.uint64(16))), pa.array(total[kept])], ["token", "df"])

        for batch in batches:
            for r, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if r != current and held:
                    yield totals()
                    held = []
                current = r
                held.append(_unpack(raw.as_buffer()))
        if held:
            yield totals()

    return run


@dataclass
class Heavy:
    """Heavy tokens, sorted, with their document frequencies."""

    token: np.ndarray
    df: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.token >> np.uint64(26)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Document frequency of each token if it is heavy, else 0."""
        out = np.zeros(len(hashes), np.int64)
        if len(self.token):
            some = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
            t = hashes[some] >> np.uint64(16)
            at = np.minimum(np.searchsorted(self.token, t), len(self.token) - 1)
            out[some] = np.where(self.token[at] == t, self.df[at], 0)
        return out


def heavy_tokens(docs: DataFrame, text: str, words: int) -> Heavy:
    """Counts over all documents; the most frequent tokens of more than LIGHT documents, at most HEAVY of them."""
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = max(parts, min(RANGES, 16 * parts))
    counted = docs.select(col(text).alias("text")).mapInArrow(_counting(words, ranges), "range int, tokens binary")
    found = written(counted.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(_heavy(LIGHT), "token long, df long"), "heavy-tokens")
    left, least = HEAVY, None
    for r in sorted(found.groupBy(F.floor(F.log2("df")).alias("power")).count().collect(), key=lambda r: -r["power"]):  # at most 64 rows
        if r["count"] > left:
            break
        left, least = left - r["count"], 1 << int(r["power"])
    rows = found.where(F.col("df") >= F.lit(least)).orderBy("token").toArrow() if least is not None else None
    remove(found)
    if rows is None:
        return Heavy(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return Heavy(rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy())


# ---- index entries


def entries(s: np.ndarray, df: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of a set: those of light tokens, and those that many sets may share. df: of its heavy tokens, else 0."""
    n = len(s)
    need = n - (percent * n + 99) // 100 + 1
    low, high = max(1, (percent * n + 99) // 100), n * 100 // percent
    powers = range(low.bit_length() - 1, high.bit_length())
    light, heavy = [], []
    if powers[0] < COMBINED:
        first = s[:need] ^ _K[0]
        small = df[:need] > 0
        light.append(first[~small])
        heavy.append(first[small])
    if powers[-1] >= COMBINED:
        rare = s[df == 0][:need]
        light.append(rare ^ _K[1])
        missing = need - len(rare)
        if missing > 0:
            common = np.flatnonzero(df)
            common = s[common[np.lexsort((s[common], df[common]))]]
            for power in powers:
                if power < COMBINED:
                    continue
                classes = max(1, (1 << power) // 40)
                kind = (common >> np.uint64(8)) % np.uint64(classes)
                order = np.argsort(kind, kind="stable")
                new = np.ones(len(common), bool)
                ranked = kind[order]
                new[order[1:]] = ranked[1:] != ranked[:-1]
                last = int(np.searchsorted(np.cumsum(~new), missing)) + 1
                tokens, kinds = common[:last], kind[:last]
                order = np.argsort(kinds, kind="stable")
                tokens, kinds = tokens[order], kinds[order]
                for group in np.split(tokens, np.flatnonzero(kinds[1:] != kinds[:-1]) + 1):
                    if len(group) > 1:
                        group = np.sort(group)
                        i, j = np.triu_indices(len(group), 1)
                        heavy.append(_mix(group[i] * _K[0] + group[j]) ^ np.uint64(power))
    join = lambda x: np.unique(np.concatenate(x)) if x else np.zeros(0, np.uint64)
    return join(light), join(heavy)


def _index(words: int, percent: int, heavy: Heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        long_list = pa.list_(pa.int64())
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), words)
            sizes = [len(s) for s in sets]
            df = np.split(heavy.of(np.concatenate(sets)) if sets else np.zeros(0, np.int64), np.cumsum(sizes)[:-1])
            node, twin, light, many, odd, wide = [], [], [], [], [], []
            for s, d in zip(sets, df, strict=True):
                print_ = fingerprint(s) if len(s) else (None, None)
                node.append(print_[0])
                twin.append(print_[1])
                odd.append(parity(s))
                wide.append(parity(s, WIDE) if len(s) > LARGE and print_ not in seen else None)
                if len(s) and print_ not in seen:  # once for all copies that this task meets
                    seen.add(print_)
                    a, b = entries(s, d, percent)
                    light.append(_signed(a))
                    many.append(_signed(b))
                else:
                    light.append(None)
                    many.append(None)
            bits = np.frombuffer(b"".join(odd), np.int64).reshape(-1, len(BITS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(node, pa.int64()), pa.array(twin, pa.int64()), pa.array(light, long_list), pa.array(many, long_list), *(pa.array(np.ascontiguousarray(b)) for b in bits.T), pa.array(wide, pa.binary())],
                ["doc_id", "tie", "n", "node", "twin", "light", "heavy", *BITS, "wide"],
            )

    return run


# ---- candidates and verification


def _lists(percent: int):
    """Pairs of each entry's sets whose sizes allow a link; of an entry with more than LIST sets (possible only beyond HEAVY) a star, as a family.

    Rows come sorted by entry; a task holds LISTED of them and those of an entry that is not at its end. Of one that
    has grown to a star already only LIST + 1 sets are held, to which the star of the others is joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
                size += batch.num_rows
            if size >= LISTED:
                table = _once(held)
                last = int(np.searchsorted(table[0], table[0][-1]))
                rest = [c[last:] for c in table]
                if len(rest[0]) > LIST + 1:
                    yield _listed(rest, percent)
                    rest = [c[: LIST + 1] for c in rest]
                yield _listed([c[:last] for c in table], percent)
                held, size = [rest], len(rest[0])
        if held:
            yield _listed(_once(held), percent)

    return run


def _once(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Rows (entry, node, n) by entry and node, each once."""
    entry, node, n = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((node, entry))
    entry, node, n = entry[order], node[order], n[order]
    new = np.concatenate([[True], (entry[1:] != entry[:-1]) | (node[1:] != node[:-1])])
    return [entry[new], node[new], n[new]]


def _listed(table: list[np.ndarray], percent: int) -> pa.RecordBatch:
    entry, node, n = table
    cuts = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1], [True]])) if len(entry) else np.zeros(1, np.int64)
    long = np.diff(cuts)
    none = np.zeros(0, np.int64)
    a, b, family = [none], [none], [np.zeros(0, bool)]
    for begin, m in zip(cuts[:-1][long > 1].tolist(), long[long > 1].tolist(), strict=True):
        mine, size = node[begin : begin + m], n[begin : begin + m]
        if m > LIST:
            i, j = np.zeros(m - 1, np.int64), np.arange(1, m)
        else:
            i, j = np.triu_indices(m, 1)
            fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
            i, j = i[fits], j[fits]
        a.append(mine[i])
        b.append(mine[j])
        family.append(np.full(len(i), m > LIST))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, family)], ["a", "b", "family"])


def _apart(percent: int):
    """Pairs whose wide parity bits allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m, n = (batch.column(k).to_numpy() for k in (2, 3))
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(len(m), -1) for k in (4, 5))
                mask = pa.array(np.bitwise_count(x ^ y).sum(1).astype(np.int64) * (100 + percent) <= (m + n) * (100 - percent))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def linked(common: int | np.ndarray, m: int | np.ndarray, n: int | np.ndarray, percent: int) -> bool | np.ndarray:
    return 100 * common >= percent * (m + n - common)


def block_links(sets: list[np.ndarray], side: np.ndarray, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets of one block, or from side 0 to side 1. label: classes that are known already."""
    sizes = np.array([len(s) for s in sets])
    tokens, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, of = tokens[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    many = np.diff(np.concatenate([first, [len(tokens)]]))
    run = np.repeat(np.arange(len(first)), many)
    begin, end = first, first + many
    # the tokens that other sets hold too, by set
    shared = many[run] > 1
    mine = np.argsort(of[shared], kind="stable")
    runs = run[shared][mine]
    cuts = np.searchsorted(of[shared][mine], np.arange(len(sets) + 1))
    label, links = np.arange(len(sets)) if label is None else label.copy(), []
    two = side.any() and not side.all()
    for i in range(len(sets)):
        if two and side[i]:
            continue
        r = runs[cuts[i] : cuts[i + 1]]
        if not len(r):
            continue
        width = end[r] - begin[r]
        inner = np.repeat(begin[r] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        common = np.bincount(of[inner], minlength=len(sets))
        near = linked(common, sizes[i], sizes, percent)
        near &= (side == 1) if two else (np.arange(len(sets)) > i)
        js = np.flatnonzero(near & (label != label[i]))
        for other in np.unique(label[js]):
            if other != label[i]:
                links.append((i, int(js[label[js] == other][0]) if (label[js] == other).any() else i))
                label[label == other] = label[i]
    return links


def _inside(percent: int):
    """Links within a block."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        nodes, sets, _ = _block(group)
        return _pairs(nodes, block_links(sets, np.zeros(len(sets), np.int64), percent))

    return run


def _across(percent: int):
    """Links between a block (side 1) and sets of other blocks (side 0), as far as they join classes."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        at_home = group.column("side").to_numpy() == 1
        parts = [_block(group.filter(pa.array(side))) for side in (~at_home, at_home)]
        classes = np.unique(np.concatenate([c for _, _, c in parts]), return_inverse=True)[1]
        side = np.repeat([0, 1], [len(n) for n, _, _ in parts])
        links = block_links(parts[0][1] + parts[1][1], side, percent, classes) if 0 < side.sum() < len(side) and classes.any() else []
        return _pairs(np.concatenate([n for n, _, _ in parts]), links)

    return run


def _block(group: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Nodes, sets and classes; rows that share an id may hold a set twice."""
    group = group.take(np.unique(group.column("node").to_numpy(), return_index=True)[1])
    nodes = group.column("node").to_numpy()
    return nodes, [np.frombuffer(x, np.uint64) for x in group.column("tokens").to_pylist()], group.column("class").to_numpy() if "class" in group.column_names else nodes


def _pairs(nodes: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([nodes[i] for i, _ in links], pa.int64()), pa.array([nodes[j] for _, j in links], pa.int64())], ["a", "b"])


def _dealt(sets: DataFrame, name: str) -> DataFrame:
    """sets (label, band, node, n, ...) with a block of their band."""
    held = sets.groupBy("label", "band").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("held") / BLOCK_TOKENS)).cast("int")
    return sets.join(held.select("label", "band", blocks.alias("blocks")), ["label", "band"]).withColumn(name, F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("blocks")


def _between(home: DataFrame, visitors: DataFrame, tokens: DataFrame, percent: int, what: str) -> DataFrame:
    """Links between sets at home in blocks (label, band, block, node, n, class) and visitors (label, band, node, n, class).

    Visitors come in chunks of a block's size, each to the blocks of its own band and of the two beside it.
    """
    columns = ["label", "home", "block", "band", "chunk"]
    visitors = written(_dealt(visitors, "chunk"), f"{what}-visitors")
    chunks = visitors.select("label", "band", "chunk").distinct().withColumn("home", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    here = home.withColumnRenamed("band", "home")
    meetings = written(chunks.join(here.select("label", "home", "block").distinct(), ["label", "home"]).select(*columns), f"{what}-meetings")
    staying = here.join(meetings, ["label", "home", "block"]).select(*columns, "node", "class", F.lit(1).alias("side"))
    coming = visitors.join(meetings, ["label", "band", "chunk"]).select(*columns, "node", "class", F.lit(0).alias("side"))
    links = written(staying.union(coming).join(tokens, "node").groupBy(*columns).applyInArrow(_across(percent), "a long, b long"), f"{what}-links")
    remove(visitors)
    remove(meetings)
    return links


def _family_links(place: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of each family's links. place: label, band, block, large, node, n; tokens: node, tokens."""
    large = place.where("large")
    any_large = large.limit(1).count() > 0
    if any_large:
        tokens = written(tokens, "jaccard-sets")
    links = written(place.join(tokens, "node").groupBy("label", "band", "block").applyInArrow(_inside(percent), "a long, b long"), "jaccard-links")
    if not any_large:
        return links

    def classed() -> DataFrame:
        known = components(links).withColumnRenamed("label", "class")
        return written(large.join(known, "node", "left").withColumn("class", F.coalesce("class", "node")), "jaccard-classed")

    sets = classed()
    grown = sets.groupBy("label", "band", "block", "class").agg(F.count("*").alias("m"), F.min(F.struct("node", "n")).alias("first")).where(F.col("m") >= CLASS)
    standing = written(grown.select("label", "band", "class", "first.*"), "jaccard-standing")
    links = links.union(_between(_dealt(standing, "block"), standing, tokens, percent, "jaccard-standing"))
    sets = classed()
    most = sets.groupBy("label", "class").agg(F.count("*").alias("m")).groupBy("label").agg(F.max_by("class", F.struct("m", "class")).alias("most"))
    outside = sets.join(most, "label").where("class <> most").select("label", "band", "node", "n", "class")
    links = links.union(_between(sets, outside, tokens, percent, "jaccard-outside"))
    remove(tokens)
    return links


def _tie(docs: DataFrame):
    """A hash of a whole row, which tells rows of one doc_id apart."""
    return F.xxhash64(F.lit(0), *map(col, plain_columns(docs)))


def classes(docs: DataFrame, *, words: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links lead to) of every document.

    Defined results: a text of fewer words than a shingle has its whole sequence as its one shingle; a null, empty or
    wordless text has none and links with nothing; repeated rows and exact copies are of one class; a null doc_id
    joins classes like any other and is nobody's component_id unless a class has no other; other columns are ignored;
    an empty table gives an empty result.
    """
    return _classes(docs, words, percent, doc_id, text).select("doc_id", "n_shingles", "component_id")


def _classes(docs: DataFrame, words: int, percent: int, doc_id: str, text: str) -> DataFrame:
    """classes(), with each row's tie and whether it is the row of its class that comes first, by doc_id, nulls last, and tie."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"), _tie(docs).alias("tie"))
    heavy = heavy_tokens(rows, "text", words)
    kinds = "doc_id long, tie long, n long, node long, twin long, light array<long>, heavy array<long>" + "".join(f", {b} long" for b in BITS) + ", wide binary"
    index = written(rows.mapInArrow(_index(words, percent, heavy), kinds), "jaccard-index")

    listed = index.select(F.explode("light").alias("entry"), "node", "n").repartition(parts, "entry").sortWithinPartitions("entry").mapInArrow(_lists(percent), "a long, b long, family boolean")
    listed = written(listed.groupBy("a", "b").agg(F.max("family").alias("family")), "jaccard-lists")
    done = [listed]  # what nothing reads once the links are there
    stars = listed.where("family").select("a", "b")
    # of the pairs those stay whose parity bits differ in no more places than sets that link can differ in tokens
    bits = index.where("light IS NOT NULL").groupBy("node").agg(F.max("n").alias("n"), *[F.max(b).alias(b) for b in BITS])
    x, y = (bits.select(*[F.col(c).alias(f"{c}_{side}") for c in bits.columns]) for side in "xy")
    seen = listed.where("NOT family").join(x, F.col("a") == F.col("node_x")).join(y, F.col("b") == F.col("node_y"))
    apart = sum((F.bit_count(F.col(f"{b}_x").bitwiseXOR(F.col(f"{b}_y"))) for b in BITS[1:]), F.bit_count(F.col("p0_x").bitwiseXOR(F.col("p0_y"))))
    pairs = written(seen.where(apart * (100 + percent) <= (F.col("n_x") + F.col("n_y")) * (100 - percent)).select("a", "b", (F.least("n_x", "n_y") > LARGE).alias("large")), "jaccard-pairs")
    done.append(pairs)
    broad = index.where("wide IS NOT NULL").select("node", "n", "wide").dropDuplicates(["node"])
    x, y = (broad.select(*[F.col(c).alias(f"{c}_{side}") for c in broad.columns]) for side in "xy")
    large = pairs.where("large").select("a", "b").join(x, F.col("a") == F.col("node_x")).join(y, F.col("b") == F.col("node_y"))
    pairs = pairs.where("NOT large").select("a", "b").union(large.select("a", "b", "n_x", "n_y", "wide_x", "wide_y").mapInArrow(_apart(percent), "a long, b long"))
    pairs = written(pairs, "jaccard-candidates")
    done.append(pairs)
    shared = index.select(F.explode("heavy").alias("entry"), "node")
    hubs = shared.groupBy("entry").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last")
    spokes = written(shared.join(hubs, "entry").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).union(stars).distinct(), "jaccard-spokes")
    done.append(spokes)
    edges = pairs.union(spokes)
    if not edges.limit(1).count():
        for df in done:
            remove(df)
        return _labelled(index, None)
    members = written(components(edges), "jaccard-families")
    done.append(members)

    # whole sets of the candidates, from one document each; a set is shuffled once, to its family's blocks
    holders = index.where("light IS NOT NULL").join(members, "node").groupBy("node").agg(F.min("doc_id").alias("holder")).select("holder").distinct()
    holders = written(holders, "jaccard-holders")
    done.append(holders)
    holders = if_small(holders, 300_000)
    texts = rows.join(holders, rows["doc_id"].eqNullSafe(holders["holder"]), "left_semi").select("text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for s in shingle_sets(batch.column(0).to_pylist(), words) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "tokens"])

    sizes = index.where("light IS NOT NULL").select("node", "n").distinct().join(members, "node")
    whole_family = sizes.groupBy("label").agg(F.count("*").alias("m"), F.sum("n").alias("held"))
    beyond = whole_family.select("label", ((F.col("m") > BLOCK_SETS) | (F.col("held") > BLOCK_TOKENS)).alias("large"))
    # a set links with none of the band after the next: sizes that link differ by a factor of 100 / percent at most
    band = F.floor(F.ln("n") / math.log(100 / min(percent, 99)) + 1e-11).cast("int")
    banded = sizes.join(beyond, "label").withColumn("band", F.when(F.col("large"), band).otherwise(0))
    place = written(_dealt(banded, "block").select("label", "band", "block", "large", "node", "n"), "jaccard-blocks")
    done.append(place)
    place = if_small(place, 300_000)
    links = _family_links(place, texts.mapInArrow(whole, "node long, tokens binary"), percent)
    for df in done:
        remove(df)
    return _labelled(index, links if links.limit(1).count() else None)


def _labelled(index: DataFrame, links: DataFrame | None) -> DataFrame:
    """Every document with the smallest doc_id of its component, and whether it is the component's first row."""
    # a class of equal sets has its first row, a component that of its classes
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie"))
    nodes = index.where("node IS NOT NULL").groupBy("node").agg(first.alias("least"))
    if links is not None:
        joined = nodes.join(components(links), "node", "left").withColumn("label", F.coalesce("label", "node"))
        nodes = joined.join(joined.groupBy("label").agg(F.min("least").alias("first")), "label").select("node", "first")
    else:
        nodes = nodes.withColumnRenamed("least", "first")
    rows = index.select("doc_id", "tie", F.col("n").alias("n_shingles"), "node").join(nodes, "node", "left")
    alone = F.col("node").isNull()
    return rows.select(
        "doc_id", "tie", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tie") == F.col("first.tie"))).alias("is_first"), alone.alias("alone"),
    )


def deduplicated(docs: DataFrame, *, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest doc_id, nulls last.

    Rows are told apart by doc_id and a hash of the whole row, so that rows of one doc_id with different texts are
    documents of their own and rows without doc_id are copies like others. Defined results: null, empty and wordless
    texts stay, repeated ones too; of wholly equal rows with words one stays; all columns pass through; an empty table
    gives an empty result.
    """
    labelled = written(_classes(docs, words, percent, doc_id, text), "jaccard-classes")
    id_, tie = free_name("__id", docs.columns), free_name("__tie", docs.columns)
    keyed = docs.withColumn(id_, col(doc_id).cast("long")).withColumn(tie, _tie(docs))

    def among(keys: DataFrame, how: str, left: DataFrame) -> DataFrame:
        keys = if_small(keys, 300_000)
        return left.join(keys, left[id_].eqNullSafe(keys["k_id"]) & (left[tie] == keys["k_tie"]), how)

    key = (F.col("doc_id").alias("k_id"), F.col("tie").alias("k_tie"))
    kept = among(labelled.where("NOT is_first").select(*key).distinct(), "left_anti", keyed)
    repeated = labelled.where("is_first AND NOT alone").groupBy(*key).count().where("count > 1").drop("count")
    if repeated.limit(1).count():
        kept = among(repeated, "left_anti", kept).union(among(repeated, "left_semi", kept).dropDuplicates([id_, tie]))
    return kept.drop(id_, tie)


OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS s FROM w),
c AS (SELECT s, min(doc_id) AS id, CAST(len(s) AS BIGINT) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT id, n, unnest(s) AS token FROM c),
p AS (
  SELECT x.id AS a, y.id AS b FROM t x JOIN t y ON x.token = y.token AND x.id < y.id AND 100 * x.n >= 90 * y.n AND 100 * y.n >= 90 * x.n
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(id, root) AS (SELECT id, id FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
k AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.component_id, s.doc_id) AS component_id
FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.id = c.id
"""
