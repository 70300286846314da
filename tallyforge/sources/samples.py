"""Sample files: small workbooks and documents as bytes, and the three sheets that examples and tests load."""

from __future__ import annotations

import csv
import io
import random
import struct
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape, quoteattr

MONTHS = ("Apr-23", "May-23", "Jun-23", "Jul-23", "Aug-23", "Sep-23", "Oct-23", "Nov-23", "Dec-23", "Jan-24", "Feb-24", "Mar-24")
YEARS = ("FY22", "FY23", "FY24")
#: Rows of the three sheets.
MONTHLY = ("GMV", "Net Revenue", "COGS", "Salary", "Marketing", "Rent", "Opex", "EBITDA", "Net Profit", "Headcount", "Orders")
AUDITED = ("Revenue from operations", "COGS", "Opex", "EBITDA", "PAT", "Trade receivables", "Inventory", "Cash", "Total debt", "Trade payables", "Salary")
MANAGED = ("Turnover", "COGS", "EBITDA", "PAT", "Debtors", "Inventory", "Opex", "Cash")

Rows = list[list]


def to_csv(rows: Rows) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def to_xlsx(sheets: dict[str, Rows]) -> bytes:
    """A workbook of texts and numbers; None leaves a cell out."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'

    def cell(row: int, column: int, value) -> str:
        name = ""
        column += 1
        while column:
            column, k = divmod(column - 1, 26)
            name = chr(65 + k) + name
        at = f'r="{name}{row + 1}"'
        return f"<c {at}><v>{value}</v></c>" if isinstance(value, int | float) else f'<c {at} t="inlineStr"><is><t>{escape(value)}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f"<workbook {main}><sheets>" + "".join(f'<sheet name={quoteattr(n)} sheetId="{k + 1}" r:id="r{k}"/>' for k, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(row) if v is not None) + "</row>" for i, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {main}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def to_docx(parts: list[str | Rows]) -> bytes:
    """A document of paragraphs (with "# " before a heading) and tables (lists of rows)."""
    paragraph = lambda text, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'
    heading = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    body = ""
    for p in parts:
        if isinstance(p, str):
            body += paragraph(p[2:], heading) if p.startswith("# ") else paragraph(p)
        else:
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(str(c))}</w:tc>" for c in row) + "</w:tr>" for row in p) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def to_xls(sheets: dict[str, Rows]) -> bytes:
    """A workbook of the binary format with shared strings and numbers, in the plainest compound file."""
    record = lambda kind, data: struct.pack("<HH", kind, len(data)) + data
    texts = list(dict.fromkeys(v for rows in sheets.values() for row in rows for v in row if isinstance(v, str)))
    wide = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    begin = record(0x809, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0))
    strings = record(0xFC, struct.pack("<II", len(texts), len(texts)) + b"".join(map(wide, texts)))
    bodies = []
    for rows in sheets.values():
        cells = b""
        for i, row in enumerate(rows):
            for j, v in enumerate(row):
                if isinstance(v, str):
                    cells += record(0xFD, struct.pack("<HHHI", i, j, 0, texts.index(v)))
                elif v is not None:
                    cells += record(0x203, struct.pack("<HHHd", i, j, 0, float(v)))
        bodies.append(record(0x809, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0)) + cells + record(0x0A, b""))
    names = [n.encode("utf-16-le") for n in sheets]
    at = len(begin) + sum(4 + 8 + len(n) for n in names) + len(strings) + 4
    bound = b""
    for n, b in zip(names, bodies, strict=True):
        bound += record(0x85, struct.pack("<IHBB", at, 0, len(n) // 2, 1) + n)
        at += len(b)
    stream = begin + bound + strings + record(0x0A, b"") + b"".join(bodies)
    stream += b"\0" * (-len(stream) % 512 + 4096 * (len(stream) < 4096))
    n = len(stream) // 512  # the stream first, then the folder's sector, then the table of sectors
    n_fat = -(-(n + 1) // 127)
    fat = [*range(1, n), 0xFFFFFFFE, 0xFFFFFFFE, *[0xFFFFFFFD] * n_fat]
    fat += [0xFFFFFFFF] * (128 * n_fat - len(fat))
    entry = lambda name, kind, first, size: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, 1 if kind == 5 else 0xFFFFFFFF) + b"\0" * 36 + struct.pack("<IQ", first, size))
    folder = entry("Root Entry", 5, 0xFFFFFFFE, 0) + entry("Workbook", 2, 0, len(stream)) + b"\0" * 256
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH6x9I", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, n, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0)
    return head.ljust(76, b"\0")[:76] + struct.pack("<109I", *[n + 1 + k for k in range(n_fat)], *[0xFFFFFFFF] * (109 - n_fat)) + stream + folder + struct.pack(f"<{len(fat)}I", *fat)


def write_samples(folder: str | Path, seed: int = 42) -> list[Path]:
    """The three sheets: a monthly one in lakhs, and an audited and a management one in crores that disagree here and there."""
    rng, folder = random.Random(seed), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    monthly = [["Metric (Rs. Lakhs)", *MONTHS]]
    for name in MONTHLY:
        base = rng.uniform(5, 90)
        monthly.append([name, *([rng.randint(20, 60)] * 12 if name == "Headcount" else [round(base * rng.uniform(0.9, 1.2), 2) for _ in MONTHS])])
    audited = {name: [round(rng.uniform(1, 30) * (1 + 0.15 * k), 2) for k in range(3)] for name in AUDITED}
    same = dict(zip(("Turnover", "COGS", "EBITDA", "PAT", "Debtors", "Inventory", "Opex", "Cash"), ("Revenue from operations", "COGS", "EBITDA", "PAT", "Trade receivables", "Inventory", "Opex", "Cash"), strict=True))
    managed = {name: [*audited[same[name]][:2], round(audited[same[name]][2] * rng.choice([1, 1.02, 0.97]), 2)] for name in MANAGED}
    sheets = {
        "meadow_foods_mis.csv": monthly,
        "harbor_engineering_audited.csv": [["Particulars (INR Crore)", *YEARS], *([k, *v] for k, v in audited.items())],
        "harbor_engineering_management.csv": [["Revenue Summary (Rs. Crore)", *YEARS], *([k, *v] for k, v in managed.items())],
    }
    out = []
    for name, rows in sheets.items():
        (folder / name).write_bytes(to_csv(rows))
        out.append(folder / name)
    return out
