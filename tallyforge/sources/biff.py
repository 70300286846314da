"""Workbooks of the binary .xls format (BIFF8 in a compound file), as far as values of cells go."""

from __future__ import annotations

import struct
from collections.abc import Iterator

COMPOUND = bytes.fromhex("d0cf11e0a1b11ae1")
#: Ends of sector chains are numbers from here on.
_END = 0xFFFFFFFA
# Record types.
BOUNDSHEET, SST, CONTINUE, EOF, BOF = 0x85, 0xFC, 0x3C, 0x0A, 0x809
LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, STRING, BOOLERR = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x06, 0x207, 0x205


def workbook(content: bytes) -> bytes:
    """The workbook's stream of a compound file."""
    size, mini = 1 << struct.unpack_from("<H", content, 30)[0], 1 << struct.unpack_from("<H", content, 32)[0]
    n_fat, first_dir, cutoff, first_mini, _, first_more, n_more = (struct.unpack_from("<I", content, at)[0] for at in (44, 48, 56, 60, 64, 68, 72))
    sector = lambda k: content[(k + 1) * size : (k + 2) * size]
    numbers = lambda raw: list(struct.unpack(f"<{len(raw) // 4}I", raw))
    tables = list(struct.unpack_from("<109I", content, 76))
    for _ in range(n_more):
        more = numbers(sector(first_more))
        tables, first_more = tables + more[:-1], more[-1]
    fat = [x for k in tables[:n_fat] if k < _END for x in numbers(sector(k))]

    def chain(first: int, table: list[int]) -> Iterator[int]:
        seen = 0
        while first < _END:
            yield first
            first, seen = table[first], seen + 1
            if seen > len(table):
                raise ValueError("a chain of sectors without an end")

    whole = lambda first: b"".join(map(sector, chain(first, fat)))
    entries, root, found = whole(first_dir), None, None
    for at in range(0, len(entries) - 127, 128):
        name = entries[at : at + max(0, struct.unpack_from("<H", entries, at + 64)[0] - 2)].decode("utf-16-le")
        place = struct.unpack_from("<I", entries, at + 116)[0], struct.unpack_from("<I", entries, at + 120)[0]
        if entries[at + 66] == 5:
            root = place
        elif name in ("Workbook", "Book") and found is None:
            found = place
    if found is None:
        raise ValueError("no workbook in the file")
    if found[1] >= cutoff or root is None:
        return whole(found[0])[: found[1]]
    small, table = whole(root[0]), [x for k in chain(first_mini, fat) for x in numbers(sector(k))]
    return b"".join(small[k * mini : (k + 1) * mini] for k in chain(found[0], table))[: found[1]]


def _records(stream: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Type and data of each record, with the records that continue it, up to the end of the part."""
    while at + 4 <= len(stream):
        kind, n = struct.unpack_from("<HH", stream, at)
        data, at = [stream[at + 4 : at + 4 + n]], at + 4 + n
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            n = struct.unpack_from("<H", stream, at + 2)[0]
            data.append(stream[at + 4 : at + 4 + n])
            at += 4 + n
        yield kind, data
        if kind == EOF:
            return


def _strings(pieces: list[bytes]) -> list[str]:
    """The shared strings. Characters of a string may go on in the next record, which then begins with how wide they are."""
    out, piece, at = [], 0, 8
    total = struct.unpack_from("<I", pieces[0], 4)[0]
    while len(out) < total:
        if at >= len(pieces[piece]):
            piece, at = piece + 1, 0
        n, flags = struct.unpack_from("<HB", pieces[piece], at)
        at += 3
        runs = struct.unpack_from("<H", pieces[piece], at)[0] if flags & 8 else 0
        at += 2 * bool(flags & 8)
        extra = struct.unpack_from("<I", pieces[piece], at)[0] if flags & 4 else 0
        at += 4 * bool(flags & 4)
        text, wide = "", flags & 1
        while True:
            width = 2 if wide else 1
            take = min(n - len(text), (len(pieces[piece]) - at) // width)
            text += pieces[piece][at : at + take * width].decode("utf-16-le" if wide else "latin-1")
            at += take * width
            if len(text) >= n:
                break
            piece, wide, at = piece + 1, pieces[piece + 1][0] & 1, 1
        skip = 4 * runs + extra
        while skip > len(pieces[piece]) - at and piece + 1 < len(pieces):
            skip -= len(pieces[piece]) - at
            piece, at = piece + 1, 0
        at += skip
        out.append(text)
    return out


def _text(raw: bytes) -> str:
    n, wide = struct.unpack_from("<HB", raw)
    return raw[3 : 3 + n * (1 + (wide & 1))].decode("utf-16-le" if wide & 1 else "latin-1")


def _number(raw: bytes) -> float:
    """A number in the short form: a double's upper half or an integer, perhaps a hundred times too large."""
    n = struct.unpack("<i", raw)[0]
    value = float(n >> 2) if n & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<i", n & ~3))[0]
    return value / 100 if n & 1 else value


def _shown(value: float) -> str:
    return str(int(value)) if value == int(value) and abs(value) < 1e15 else repr(value)


def rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Sheet, row and cells as text, row by row."""
    stream = workbook(content)
    sheets, strings = [], []
    for kind, data in _records(stream, 0):
        if kind == BOUNDSHEET:
            at, n, wide = struct.unpack_from("<I", data[0])[0], data[0][6], data[0][7] & 1
            sheets.append((at, data[0][8 : 8 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1")))
        elif kind == SST:
            strings = _strings(data)
    for begin, name in sheets:
        cells: dict[int, dict[int, str]] = {}
        last = None
        for kind, data in _records(stream, begin):
            raw = data[0]
            if kind in (LABELSST, LABEL, NUMBER, RK, MULRK, FORMULA, BOOLERR):
                row, column = struct.unpack_from("<HH", raw)
                line = cells.setdefault(row, {})
            if kind == LABELSST:
                line[column] = strings[struct.unpack_from("<I", raw, 6)[0]]
            elif kind == LABEL:
                line[column] = _text(raw[6:])
            elif kind == NUMBER:
                line[column] = _shown(struct.unpack_from("<d", raw, 6)[0])
            elif kind == RK:
                line[column] = _shown(_number(raw[6:10]))
            elif kind == MULRK:
                for k in range((len(raw) - 6) // 6):
                    line[column + k] = _shown(_number(raw[6 + 6 * k : 10 + 6 * k]))
            elif kind == FORMULA:
                if raw[12:14] != b"\xff\xff":
                    line[column] = _shown(struct.unpack_from("<d", raw, 6)[0])
                elif raw[6] == 0:
                    last = line, column  # a text, which follows
            elif kind == STRING and last:
                last[0][last[1]] = _text(raw)
                last = None
            elif kind == BOOLERR and not raw[7]:
                line[column] = "TRUE" if raw[6] else "FALSE"
        for row in sorted(cells):
            line = cells[row]
            yield name, row, [line.get(k, "") for k in range(max(line) + 1)]
