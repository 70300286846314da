"""Word documents and page blocks as chunks of text and as grids."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import resolve_headers
from ..operators.ingest import looks_like_period

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def parts(content: bytes) -> Iterator[tuple[str, int, int, int, str, str]]:
    """kind, index, row, column, style, text of paragraphs and of table cells, in the document's order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    paragraph = table = 0
    for node in body:
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            yield "paragraph", paragraph, 0, 0, "" if style is None else style.get(f"{_W}val", ""), _text(node).strip()
            paragraph += 1
        elif node.tag == f"{_W}tbl":
            for i, row in enumerate(node.iterfind(f"{_W}tr")):
                for j, cell in enumerate(row.iterfind(f"{_W}tc")):
                    yield "table", table, i, j, "", _text(cell).strip()
            table += 1


def read_parts(files: DataFrame) -> DataFrame:
    """file_id, kind, index, row_idx, col_idx, style, text of Word files (file_id, content); a file that cannot be read gives one row with its error instead."""
    names = ["file_id", "kind", "index", "row_idx", "col_idx", "style", "text", "error"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(file_id, *p, None) for p in parts(content)]
                except Exception as e:
                    rows = [(file_id, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = files.select(F.col("file_id").cast("int").alias("file_id"), "content")
    return rows.mapInArrow(run, "file_id int, kind string, index int, row_idx int, col_idx int, style string, text string, error string")


def paragraphs(read: DataFrame) -> DataFrame:
    """Body paragraphs with the heading above them; short ones and marked ones are footnotes or annotations.

    A document's paragraphs are put in order by its row in an array: a document fits a row, as its file did.
    """
    rows = read.where("kind = 'paragraph' AND text <> ''")
    whole = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("index", "style", "text"))).alias("all"))
    p = whole.select("file_id", "all", F.posexplode("all").alias("nth", "p"))
    above = F.filter("all", lambda x: (x["index"] <= F.col("p.index")) & F.lower(x["style"]).startswith("heading"))
    marked = F.col("text").rlike("^[*†]")
    few = F.size(F.split(F.trim("text"), r"\s+")) < 20
    out = p.where(~F.lower(F.col("p.style")).startswith("heading")).select("file_id", F.col("p.index").alias("chunk_index"), F.coalesce(F.try_element_at(above, F.lit(-1))["text"], F.lit("")).alias("section_path"), F.col("p.text").alias("text"))
    kind = F.when(few | marked, "footnote").otherwise("narrative")
    region = F.when(few | marked, "inline_annotation").otherwise("narrative")
    return out.select("file_id", "chunk_index", region.alias("region_type"), kind.alias("chunk_type"), "section_path", F.col("text").alias("raw_text"))


def tables(read: DataFrame) -> DataFrame:
    """Each table with is_structured: at least two headers are metrics, or two are periods."""
    heads = read.where("kind = 'table' AND row_idx = 0")
    known = resolve_headers(heads, "text")
    found = heads.join(known, "text", "left").groupBy("file_id", "index").agg(F.count("metric").alias("metrics"), F.count_if(looks_like_period(F.col("text"))).alias("periods"))
    return found.select("file_id", "index", ((F.col("metrics") >= 2) | (F.col("periods") >= 2)).alias("is_structured"))


def table_grid(read: DataFrame) -> DataFrame:
    """Structured tables as a grid, so that they take the same way as sheets."""
    good = tables(read).where("is_structured")
    cells = read.where("kind = 'table'").join(good, ["file_id", "index"])
    return cells.select("file_id", F.concat(F.lit("table "), F.col("index").cast("string")).alias("sheet"), "row_idx", "col_idx", F.col("text").alias("raw"))


def table_chunks(read: DataFrame) -> DataFrame:
    """Other tables as chunks of text: a line for each row."""
    other = tables(read).where("NOT is_structured")
    cells = read.where("kind = 'table'").join(other, ["file_id", "index"])
    rows = cells.groupBy("file_id", "index", "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "text"))), lambda x: x["text"]), " | ").alias("line"))
    whole = rows.groupBy("file_id", "index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "line"))), lambda x: x["line"]), "\n").alias("raw_text"))
    return whole.select("file_id", F.col("index").alias("chunk_index"), F.lit("table").alias("region_type"), F.lit("table").alias("chunk_type"), F.lit("").alias("section_path"), "raw_text")


def region(x0: Column, y0: Column, x1: Column, y1: Column, page_height: Column, text: Column) -> Column:
    """Region of a page block: wide ones are tables, short ones and those at the foot are footnotes, the rest is narrative."""
    width, height = x1 - x0, y1 - y0
    return F.when((width > 2 * height) & (height > 5), "table").when((F.size(F.split(F.trim(text), r"\s+")) < 20) | (y0 > page_height * 0.85), "footer_notes").otherwise("narrative")


def block_chunks(blocks: DataFrame) -> DataFrame:
    """Chunks of page blocks (file_id, page, x0, y0, x1, y1, text, page_height), as any reader of pages gives them."""
    kind = region(*(F.col(c) for c in ("x0", "y0", "x1", "y1", "page_height", "text")))
    rows = blocks.where(F.trim("text") != "").withColumn("region_type", kind)
    chunk = F.when(F.col("region_type") == "table", "table").when(F.col("region_type") == "footer_notes", "footnote").otherwise("narrative")
    return rows.select("file_id", "page", "y0", "region_type", chunk.alias("chunk_type"), F.concat(F.lit("page "), F.col("page").cast("string")).alias("section_path"), F.trim("text").alias("raw_text"))
