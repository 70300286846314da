"""Spreadsheets as grids: CSV and XLSX files, read by Spark as binary files, so any store that Spark reads will do.

A file is the unit of parsing (formats such as XLSX cannot be split); everything after that works on the grid.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import biff

SUFFIXES = (".csv", ".xlsx", ".xls")
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def glob(suffixes: tuple[str, ...] = SUFFIXES) -> str:
    """A pattern for names with these suffixes, in whatever case."""
    either = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    return "*{" + ",".join(map(either, suffixes)) + "}"


def described(files: DataFrame) -> DataFrame:
    """path, filename, file_type, checksum (SHA-256), content of files as Spark reads binary ones."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("filename"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("file_type"), F.sha2("content", 256).alias("checksum"), "content")


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The described files right in a folder, in order of path; other files are not opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob(suffixes)).load(folder)
    return described(files).where(F.col("file_type").isin(*suffixes)).orderBy("path")


def new_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose checksum is not known yet, once each (the first by path, if there are paths): loading a folder twice changes nothing."""
    if "path" in files.columns:
        first = files.groupBy("checksum").agg(F.min("path").alias("path"))
        return files.join(first, ["checksum", "path"]).dropDuplicates(["checksum"]).join(known.select("checksum"), "checksum", "left_anti")
    return files.dropDuplicates(["checksum"]).join(known.select("checksum"), "checksum", "left_anti")


def csv_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    for i, row in enumerate(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")))):
        yield "", i, row


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheet_names(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS)]


# The built-in number formats that show dates.
DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}


def is_date_format(code: str) -> bool:
    """Whether a format of one's own shows a date: day or year letters outside of quotes and brackets."""
    return bool(re.search("[dy]|mmm", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code.lower())))


def date_text(serial: float) -> str:
    """A date serial as text, like a reader of strings shows it: days since 1899-12-30, with the time if there is one."""
    moment = datetime(1899, 12, 30) + timedelta(seconds=round(serial * 86400))
    return moment.strftime("%Y-%m-%d" if moment.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


def _date_styles(styles: bytes) -> set[str]:
    """Numbers of the cell styles that show dates."""
    root = ElementTree.fromstring(styles)
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    shown = lambda n: int(n) in DATE_FORMATS or n in own and is_date_format(own[n])
    return {str(k) for k, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if shown(x.get("numFmtId", "0"))}


def _shown(value: str, dated: bool, kind: str | None) -> str:
    return date_text(float(value)) if dated and kind in (None, "n") else value


def xlsx_rows(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        inside = set(z.namelist())
        strings = []
        if "xl/sharedStrings.xml" in inside:
            strings = ["".join(t.text or "" for t in s.iterfind(".//m:t", _NS)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS)]
        dates = _date_styles(z.read("xl/styles.xml")) if "xl/styles.xml" in inside else set()
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", _NS):
            target = targets[sheet.get(_REL)]
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            for k, row in enumerate(ElementTree.fromstring(z.read(part)).iterfind(".//m:row", _NS)):
                cells: list[str] = []
                for c in row.iterfind("m:c", _NS):
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    value = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iterfind(".//m:t", _NS))
                    elif value is not None and value.text is not None:
                        cells[at] = strings[int(value.text)] if c.get("t") == "s" else _shown(value.text, c.get("s") in dates, c.get("t"))
                yield sheet.get("name"), int(row.get("r", k + 1)) - 1, cells


def rows_of(kind: str, content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Sheet, row, cells of a file; an .xls file may hold any of three formats."""
    if kind == ".csv":
        return csv_rows(content)
    if content[:4] == b"PK\x03\x04" or kind == ".xlsx":
        return xlsx_rows(content)
    return biff.rows(content) if content[:8] == biff.COMPOUND else csv_rows(content)


def read_grid(files: DataFrame) -> DataFrame:
    """file_id, sheet, row_idx, col_idx, raw of all files; a file that cannot be read gives one row with its error instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, kind, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                out: list[tuple] = []
                try:
                    for sheet, i, row in rows_of(kind, content):
                        out += [(file_id, sheet, i, j, v, None) for j, v in enumerate(row)]
                        if len(out) > 50_000:
                            yield _batch(out)
                            out = []
                except Exception as e:
                    out = [(file_id, None, None, None, None, f"{type(e).__name__}: {e}")]
                if out:
                    yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file_id", "sheet", "row_idx", "col_idx", "raw", "error"])

    files = files.select(F.col("file_id").cast("int").alias("file_id"), "file_type", "content")
    return files.mapInArrow(run, "file_id int, sheet string, row_idx int, col_idx int, raw string, error string")
