"""Total rows of sheets held against the lines above them: which block of lines does a total add up, and does it?

In a column of a sheet the lines before each row are summed up once. A total T after lines that sum to P adds up the
block that begins at a line whose own sum before it is P - T, so all blocks are found by one equi-join of sums; nested
totals count only the lines below them. Sums are made by parts of a column, so a sheet of any length is no single task.
Sheets that are known to be short (whole) are dealt by file and sheet once; all that follows stays in that task, so
rows are shuffled once, and not at all if their files are together already.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.aliases import resolve_headers
from ..functions.text import cell_reference, parse_number

COLUMN = ["file_id", "sheet", "col_idx"]
#: Rows of a part of a column.
PART = 1 << 16

# What the label of a total begins or ends with, and that of a line that is taken off.
TOTAL = r"(?i)^\W*(sub\s*-?\s*total|grand\s+total|total|sum of)\b|\b(sub\s*-?\s*total|total)\W*$"
LESS = r"(?i)^\W*(less\b|\(-\))"

Running = dict[str, tuple[Callable, Column]]


def running(rows: DataFrame, key: list[str], at: str, wanted: Running, part: int = PART) -> DataFrame:
    """rows with, for each name, the sum or maximum of a column over all rows of the key before it (null before the first).

    at numbers the rows of a key, not necessarily without gaps; only rows of one part of a key meet in a window, beside
    the parts' own sums.
    """
    dealt = rows.withColumn("__part", F.floor(F.col(at) / part))
    of_parts = dealt.groupBy(*key, "__part").agg(*[f(c).alias(f"__{n}") for n, (f, c) in wanted.items()])
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    of_parts = of_parts.select(*key, "__part", *[f(F.col(f"__{n}")).over(before).alias(f"__{n}") for n, (f, _) in wanted.items()])
    within = Window.partitionBy(*key, "__part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)

    def joined(name: str, f: Callable, c: Column) -> Column:
        inside, outside = f(c).over(within), F.col(f"__{name}")
        if f is F.sum:
            return F.when(inside.isNull(), outside).when(outside.isNull(), inside).otherwise(inside + outside)
        return F.greatest(inside, outside)

    found = dealt.join(of_parts, [*key, "__part"])
    return found.select(*rows.columns, *[joined(n, f, c).alias(n) for n, (f, c) in wanted.items()])


def marked(cells: DataFrame, *, whole: bool = False) -> DataFrame:
    """Rows of each column that hold numbers: kind (line, total, heading), label, value (negative for a line taken off), places after the point.

    cells as ingest.cells() gives them: file_id, sheet, row_idx, col_idx, raw. A label without a number is a heading; rows without both are left out.
    whole: sheets are short, so the cells of one may meet in a task.
    """
    label = F.trim("raw")
    if whole:
        so_far = Window.partitionBy("file_id", "sheet").orderBy("row_idx", "col_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.last(F.when(F.col("col_idx") == 0, F.struct("row_idx", label.alias("label"))), ignorenulls=True).over(so_far)
        values = cells.withColumn("__last", last).where("col_idx > 0 AND __last.row_idx = row_idx").withColumn("label", F.col("__last.label")).drop("__last")
    else:
        values = cells.where("col_idx > 0").join(cells.where("col_idx = 0").select("file_id", "sheet", "row_idx", label.alias("label")), ["file_id", "sheet", "row_idx"])
    rows = values.where("label <> '' AND NOT startswith(label, '---')").withColumn("number", parse_number(F.col("raw")))
    shown = F.regexp_extract(F.regexp_replace("raw", ",", ""), r"\.(\d+)", 1)
    total = F.col("label").rlike(TOTAL)
    kind = F.when(F.col("number").isNull(), "heading").when(total, "total").otherwise("line")
    number = F.col("number").cast("decimal(24,6)")
    rows = rows.withColumns({"kind": kind, "value": F.when(F.col("label").rlike(LESS) & ~total, -F.abs(number)).otherwise(number), "places": F.length(shown)})
    return rows.select(*COLUMN, "row_idx", "label", "kind", "value", "places", *(["skip"] if "skip" in cells.columns else []))


def check(rows: DataFrame, *, whole: bool = False) -> DataFrame:
    """Each total row of marked() rows: total, first_row and n_lines of the block that it adds up, n_totals within it, status and difference.

    status: matches, if a block that ends before the total sums to it, give or take half a unit of the last place shown
    for each line and the total; of several blocks the shortest one that begins a section (after a heading, a total, or
    the column's start) counts, else the shortest. Else differs: the block is then that since the last section's start
    or, if it is nearer or there is none, all lines above; difference is the total less its sum. A total without any line
    above has status empty. Zeros, repeated values and negative lines are lines like others; columns without numbers have no totals.
    whole: columns are short, so the rows of one may meet in a task.
    """
    is_line = F.col("kind") == "line"
    column = Window.partitionBy(*COLUMN)
    above = column.orderBy("row_idx").rowsBetween(Window.unboundedPreceding, -1)
    add = (lambda df, wanted: df.select("*", *[f(c).over(above).alias(n) for n, (f, c) in wanted.items()])) if whole else (lambda df, wanted: running(df, COLUMN, "row_idx", wanted))
    summed = add(rows, {"before": (F.sum, F.when(is_line, F.col("value"))), "lines": (F.sum, F.when(is_line, 1)), "totals": (F.sum, F.when(F.col("kind") == "total", 1))})
    summed = summed.withColumns({"before": F.coalesce("before", F.lit(0)).cast("decimal(28,6)"), "lines": F.coalesce("lines", F.lit(0)), "totals": F.coalesce("totals", F.lit(0))})
    start = F.when(~is_line, F.struct("lines", "before"))
    summed = add(summed, {"section": (F.max, start)})
    summed = summed.withColumn("section", F.coalesce("section", F.struct(F.lit(0).cast("bigint").alias("lines"), F.lit(0).cast("decimal(28,6)").alias("before"))))
    # how far a sum of so many rounded values may be off, and the grid on which sums are joined
    if whole:
        summed = summed.withColumns({"shown": F.max(F.coalesce("places", F.lit(0))).over(column), "n": F.count_if(is_line).over(column)})
    else:
        summed = summed.join(rows.groupBy(*COLUMN).agg(F.max(F.coalesce("places", F.lit(0))).alias("shown"), F.count_if(is_line).alias("n")), COLUMN)
    unit = F.pow(F.lit(10.0), -F.least("shown", F.lit(6)))
    summed = summed.withColumns({"half": (unit / 2).cast("decimal(28,7)"), "grid": (F.col("n") + 1) * unit / 2}).drop("shown", "n")
    place = lambda c: F.floor(c.cast("double") / F.col("grid"))
    begins = F.col("lines") == F.col("section.lines")
    # a block that begins with zeros amid a section sums to the same as the one after them
    is_start = is_line & (begins | (F.col("value") != 0))
    a_start = F.struct(begins.alias("begins"), F.col("row_idx").alias("first_row"), F.col("lines").alias("lines"), F.col("totals").alias("totals"), F.col("before").alias("before"))
    near_by = [(k, place(F.col("before") - F.col("value")) + k) for k in (-1, 0, 1)]
    off = lambda s: F.col("value") - (F.col("before") - s["before"])
    fits = lambda s: (s["lines"] < F.col("lines")) & (F.abs(off(s)) <= F.col("half") * (F.col("lines") - s["lines"] + 1))
    found_by = lambda s: F.struct(s["begins"].alias("begins"), s["first_row"].alias("first_row"), s["lines"].alias("lines"), s["totals"].alias("totals"), off(s).alias("off"))
    if whole:
        mark = lambda k, at, s=None: F.struct(F.lit(k).alias("k"), at.alias("place"), (F.lit(None) if s is None else s).alias("start"))
        marks = F.when(is_start, F.array(mark(None, place(F.col("before")), a_start))).when(F.col("kind") == "total", F.array(*[mark(k, at) for k, at in near_by]))
        dealt = summed.withColumn("__mark", F.explode(marks)).select("*", "__mark.k", "__mark.place", "__mark.start").drop("__mark")
        tried = dealt.withColumn("starts", F.collect_list("start").over(Window.partitionBy(*COLUMN, "place"))).where("kind = 'total' AND (k = 0 OR size(starts) > 0)")
        best = F.when(F.size("starts") > 0, F.array_max(F.transform(F.filter("starts", fits), found_by)))
        tried = tried.withColumn("best", best).drop("starts", "start").where("k = 0 OR best IS NOT NULL")
        out = tried.withColumn("best", F.max("best").over(Window.partitionBy(*COLUMN, "row_idx"))).where("k = 0")
    else:
        starts = summed.where(is_start).select(*COLUMN, place(F.col("before")).alias("place"), a_start.alias("start"))
        totals = summed.where("kind = 'total'")
        wanted = totals.select(*COLUMN, "row_idx", "value", "before", "lines", "totals", "half", F.explode(F.array(*[at for _, at in near_by])).alias("place"))
        tried = wanted.join(starts, [*COLUMN, "place"]).where(fits(F.col("start")))
        best = tried.groupBy(*COLUMN, "row_idx").agg(F.max(found_by(F.col("start"))).alias("best"))
        out = totals.join(best, [*COLUMN, "row_idx"], "left")
    near, far = F.col("value") - (F.col("before") - F.col("section.before")), F.col("value") - F.col("before")
    since = (F.col("lines") > F.col("section.lines")) & (F.abs(near) <= F.abs(far))
    status = F.when(F.col("best").isNotNull(), "matches").when(F.col("lines") == 0, "empty").otherwise("differs")
    found = F.col("best").isNotNull()
    return out.select(
        *COLUMN, "row_idx", "label", F.col("value").alias("total"), status.alias("status"),
        F.col("best.first_row").alias("first_row"),
        (F.col("lines") - F.when(found, F.col("best.lines")).when(since, F.col("section.lines")).otherwise(0)).alias("n_lines"),
        F.when(found, F.col("totals") - F.col("best.totals")).otherwise(0).alias("n_totals"),
        F.when(found, F.col("best.off")).when(since, near).otherwise(far).cast("decimal(28,6)").alias("difference"),
        *(["skip"] if "skip" in rows.columns else []),
    )


def labelled(cells: DataFrame, *, compat: bool = False) -> DataFrame:
    """Labels of cells that are totals by name; those that name a metric by themselves (total debt) need not be totals of what is above them."""
    names = cells.where("col_idx = 0").select(F.trim("raw").alias("label")).where(F.col("label").rlike(TOTAL)).distinct()
    return names.join(resolve_headers(names, "label", compat).where("metric IS NOT NULL").select("label"), "label", "left_anti")


def log(found: DataFrame) -> DataFrame:
    """Totals that differ, as rows of the ingestion log."""
    skip = F.col("skip") if "skip" in found.columns else F.lit(0)
    cell = cell_reference(F.col("col_idx") + 1, F.col("row_idx") + skip + 2)
    said = F.concat_ws(" ", F.when(F.col("sheet") != "", F.col("sheet")), cell, F.lit("is off by"), F.col("difference").cast("decimal(28,2)").cast("string"))
    return found.where("status = 'differs'").select("file_id", F.lit("total_differs").alias("event"), said.alias("detail"))
