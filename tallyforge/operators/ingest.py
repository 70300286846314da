"""From a grid of strings to staged facts: one program over all sheets, whatever their widths and layouts.

A grid has file_id, sheet, row_idx, col_idx, raw; cells are the same below the header row, with their column's header.
What differs from sheet to sheet (header row, layout, unit, entity) is one row for each sheet, joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import periods, units
from ..functions.aliases import resolve_headers
from ..functions.text import cell_reference, parse_number, slugify
from ..registry import LEDGER_WORDS, METRICS
from .store import if_small, scratch

SHEET = ["file_id", "sheet"]
#: Rows in which a header can lie.
HEAD = 30

# Fixed value: what a period can begin with.
_PERIOD = (
    r"(?i)^\s*(FY\s*\d{2,4}|Q[1-4]\s*FY\s*\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]\d{2,4}|\d{4})"
)
# Words that make a text a unit's, the ones of scale first; lines that name no entity; words that are no part of a name.
SCALES = ("crore", "lakh", "lacs", "lakhs", "cr.", "thousand", "000", "million")
UNIT_WORDS = (*SCALES, "rs.", "inr", "usd", "rupee")
_DISCLAIMER = r"(?i)all numbers|unless mentioned|figures in|amounts in|values in|note:|notes:|source:|currency:|in rs\.|in inr\b"
NOT_NAMES = (
    "pnl", "pl", "balance", "sheet", "bs", "monthly", "annual", "quarterly", "audited", "accounts", "mis", "management", "report", "financials",
    "financial", "data", "fy", "fy22", "fy23", "fy24", "fy25", "fy26", "cim", "deck", "model", "final", "v1", "v2", "v3", "revised", "draft", "copy",
    "export", "tally", "summary", "detail", "detailed", "overview", "income", "statement", "profit", "loss", "p&l",
)


def looks_like_period(c: Column) -> Column:
    return c.rlike(_PERIOD)


def _filled(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


def discover(grid: DataFrame) -> DataFrame:
    """For each sheet: header_row, preamble (the lone cells above it), and unit text.

    The header is the first of the HEAD first rows with nearly as many cells as the fullest of them.
    """
    top = grid.where((F.col("row_idx") < HEAD) & _filled(F.col("raw")))
    rows = top.groupBy(*SHEET, "row_idx").agg(F.count("*").alias("n"), F.min_by("raw", "col_idx").alias("first"))
    sheets = rows.groupBy(*SHEET).agg(F.max("n").alias("most"), F.sort_array(F.collect_list(F.struct("row_idx", "n", "first"))).alias("rows"))
    header = F.get(F.filter("rows", lambda r: r["n"] >= F.greatest(F.lit(2), F.col("most") - 1)), F.lit(0))["row_idx"]
    found = sheets.withColumn("header_row", F.coalesce(header, F.lit(0)))
    found = found.withColumn("preamble", F.transform(F.filter("rows", lambda r: (r["row_idx"] < F.col("header_row")) & (r["n"] == 1)), lambda r: F.trim(r["first"])))
    near = grid.join(if_small(found.select(*SHEET, "header_row")), SHEET).where(F.col("row_idx").between(F.col("header_row"), F.col("header_row") + 3) & _filled(F.col("raw")))
    near = near.where((F.col("row_idx") == F.col("header_row")) | (F.col("col_idx") == 0))
    texts = near.groupBy(*SHEET).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "col_idx", "raw"))), lambda x: x["raw"]).alias("texts"))
    holds = lambda words: lambda t: F.lower(t).rlike("|".join(w.replace(".", r"\.") for w in words))
    candidates = F.concat("preamble", F.coalesce("texts", F.array().cast("array<string>")))
    unit = F.coalesce(F.get(F.filter(candidates, holds(SCALES)), F.lit(0)), F.get(F.filter(candidates, holds(UNIT_WORDS)), F.lit(0)), F.lit(""))
    return found.join(texts, SHEET, "left").select(*SHEET, "header_row", "preamble", unit.alias("unit"))


def cells(grid: DataFrame, sheets: DataFrame) -> DataFrame:
    """Cells below the header: row_idx from 0, header (blank: __UNNAMED__; repeated: name__k), skip (rows down to the header)."""
    rows = grid.join(if_small(sheets.select(*SHEET, "header_row")), SHEET)
    name = F.when(_filled(F.col("raw")), F.trim("raw")).otherwise("__UNNAMED__")
    heads = rows.where("row_idx = header_row").select(*SHEET, "col_idx", name.alias("header"))
    k = F.row_number().over(Window.partitionBy(*SHEET, "header").orderBy("col_idx")) - 1
    heads = heads.withColumn("k", k).select(*SHEET, "col_idx", F.when(F.col("k") > 0, F.concat_ws("__", "header", "k")).otherwise(F.col("header")).alias("header"))
    below = rows.where("row_idx > header_row").withColumn("skip", F.col("header_row")).withColumn("row_idx", F.col("row_idx") - F.col("header_row") - 1)
    return below.join(if_small(heads), [*SHEET, "col_idx"]).select(*SHEET, "row_idx", "col_idx", "header", "raw", "skip")


def layouts(table: DataFrame, *, compat: bool = False) -> DataFrame:
    """layout of each sheet (wide, tall, ledger) and how many of its columns are periods."""
    column = F.when(looks_like_period(F.col("header")), F.col("col_idx"))
    label = (F.col("col_idx") == 0) & (F.col("row_idx") < 10) & looks_like_period(F.coalesce("raw", F.lit("")))
    first = F.min_by("header", "col_idx")
    found = table.groupBy(*SHEET).agg(F.count_distinct(column).alias("periods"), F.count_if(label).alias("labels"), F.lower(first).alias("first"))
    if compat:
        ledger = F.col("first").rlike("|".join(LEDGER_WORDS))
    else:
        ledger = F.col("first").rlike(rf"\b({'|'.join(LEDGER_WORDS)})\b") & (F.col("periods") < 2)
    layout = F.when(ledger, "ledger").when(F.col("periods") >= 2, "wide").when(F.col("labels") >= 2, "tall").otherwise("wide")
    return found.select(*SHEET, "periods", layout.alias("layout"))


def _skipped(label: Column, ledger: Column, known: Column) -> Column:
    """Rows that state no metric: blanks, rules, and totals unless they are a name by themselves."""
    total = label.rlike(r"(?i)^\s*(total|grand total|subtotal)\s*$") & ~known
    return ~_filled(label) | label.startswith("---") | total | (ledger & (label.startswith("===") | label.rlike(r"(?i)^\s*balance\s*$")))


def extract(table: DataFrame, sheet_units: DataFrame, *, compat: bool = False) -> DataFrame:
    """Staged facts of all sheets. table: cells; sheet_units: file_id, sheet, unit.

    wide: labels are metrics, period columns hold values; tall: labels are periods, headers metrics; ledger: labels are
    metrics, every column holds values of the period in its header, or FY24. Counts and percentages are not scaled
    unless compat.
    """
    if "skip" not in table.columns:
        table = table.withColumn("skip", F.lit(0))
    about = if_small(scratch(layouts(table, compat=compat).join(sheet_units.select(*SHEET, "unit"), SHEET, "left"), "layouts"))
    labels = table.where("col_idx = 0").select(*SHEET, "row_idx", F.trim("raw").alias("label"))
    rows = table.where("col_idx > 0").join(labels, [*SHEET, "row_idx"]).join(about, SHEET)
    tall, ledger = F.col("layout") == "tall", F.col("layout") == "ledger"
    rows = rows.where((F.col("layout") != "wide") | (F.col("periods") == 0) | looks_like_period(F.col("header")))
    rows = rows.withColumn("named", F.when(tall, F.col("header")).otherwise(F.col("label"))).withColumn("dated", F.when(tall, F.col("label")).otherwise(F.col("header")))
    # names, units and periods are read once for each text that sheets have, written together, and joined back
    rows = rows.withColumn("of_ledger", ledger).withColumn("unit", F.coalesce("unit", F.lit("")))
    read = if_small(_texts(rows.select("named", "unit", "of_ledger", "dated"), compat))
    known = read.where("named IS NOT NULL").select("named", "unit", "of_ledger", "metric", "currency", "original_unit", "factor")
    rows = rows.join(known, ["named", "unit", "of_ledger"]).join(read.where("dated IS NOT NULL").select("dated", "period"), "dated")
    rows = rows.where(~_skipped(F.col("label"), ledger, F.col("metric").isNotNull()))
    period = F.when(ledger, F.lit("FY24") if compat else F.coalesce("period", F.lit("FY24"))).otherwise(F.col("period"))
    rows = rows.withColumn("period", period).withColumn("raw_value", parse_number(F.col("raw"))).where("period IS NOT NULL AND raw_value IS NOT NULL")
    money = F.col("metric").isin([m.name for m in METRICS if m.unit == "currency"])
    plain = ~money & F.lit(not compat)
    shift = 1 if compat else 2
    value = F.col("raw_value").cast("decimal(24,6)")
    return rows.select(
        *SHEET, "layout", F.col("metric").alias("canonical_field"), "period",
        F.when(plain, value).otherwise(value * F.col("factor").cast("decimal(10,0)")).cast("decimal(28,6)").alias("value_normalised"),
        "currency", "original_unit", F.when(plain, 1.0).otherwise(F.col("factor").cast("double")).alias("conversion_factor"), ((F.col("factor") != 1) & ~plain).alias("conversion_applied"),
        "raw_value", F.col("named").alias("raw_header"), F.col("label").alias("row_context"),
        cell_reference(F.col("col_idx") + 1, F.col("row_idx") + F.col("skip") + shift).alias("cell_reference"), "row_idx", "col_idx",
    )


def _texts(rows: DataFrame, compat: bool) -> DataFrame:
    """Two kinds of rows: metric, currency, unit and factor of each name (named, unit, of_ledger) that a metric is known for, in a ledger by the sheet's unit; period of each text that dates (dated)."""
    names = rows.select("named", "unit", "of_ledger").distinct()
    known = names.join(resolve_headers(names, "named", compat).where("metric IS NOT NULL"), "named")
    own = F.when(~F.col("of_ledger"), units.row_unit(F.col("named"), F.col("unit")))
    measured = known.withColumn("u", units.detect_unit(F.coalesce(own, F.col("unit")), compat))
    no = lambda kind: F.lit(None).cast(kind)
    named = measured.select("named", "unit", "of_ledger", "metric", F.col("u.currency").alias("currency"), F.col("u.label").alias("original_unit"), F.col("u.multiplier").alias("factor"), no("string").alias("dated"), no("string").alias("period"))
    kinds = {f.name: f.dataType for f in named.schema.fields}
    dated = rows.where("dated IS NOT NULL").select("dated").distinct().withColumn("period", periods.parse_period(F.col("dated")))
    dated = dated.select(*[F.col(c) if c in ("dated", "period") else no(k).alias(c) for c, k in kinds.items()])
    return scratch(named.unionAll(dated), "texts")


def unmapped(table: DataFrame, *, compat: bool = False) -> DataFrame:
    """Headers and labels that no metric is known for, by sheet: what a mapper may be asked."""
    about = layouts(table, compat=compat)
    rows = table.join(if_small(about), SHEET)
    named = F.when((F.col("layout") == "tall") & (F.col("col_idx") > 0) & ~looks_like_period(F.col("header")), F.col("header")).when((F.col("layout") != "tall") & (F.col("col_idx") == 0), F.trim("raw"))
    rows = rows.withColumn("named", named).where(_filled(F.col("named"))).select(*SHEET, "named").distinct()
    return rows.join(if_small(resolve_headers(rows, "named", compat).where("metric IS NULL").select("named")), "named")


def annotations(table: DataFrame) -> DataFrame:
    """Cells of note columns as chunks; any digit counts as a claim."""
    rows = table.where(F.lower(F.trim("header")).rlike("^(note|annotation|remark|comment|footnote|addendum)") & _filled(F.col("raw")))
    return rows.select(
        *SHEET, F.col("row_idx").cast("int").alias("chunk_index"), F.lit("inline_annotation").alias("region_type"), F.lit("footnote").alias("chunk_type"),
        F.trim("raw").alias("raw_text"), F.col("raw").rlike(r"\d").alias("contains_numerical_claim"),
    )


def entity_names(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """file_id and entity_name: from the preamble, else from the file's name. sheets: discover(); files: file_id, filename."""
    number = r"^\d{2,4}$"
    kept = lambda words: F.filter(words, lambda w: (w != "") & ~w.rlike(number) & ~F.lower(w).isin(*NOT_NAMES))
    lines = F.filter("preamble", lambda t: ~t.rlike(_DISCLAIMER))
    bare = F.transform(lines, lambda t: F.trim(F.split(F.trim(F.regexp_replace(t, r"\(.*?\)", "")), r"\s*[-|:]\s*")[0]))
    names = F.filter(F.transform(bare, lambda t: F.array_join(kept(F.split(t, r"[\s_]+")), " ")), lambda t: F.length(t) >= 3)
    first = sheets.groupBy("file_id").agg(F.min_by("preamble", "sheet").alias("preamble"))
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    title = lambda t: F.regexp_replace(F.initcap(F.regexp_replace(t, "(['0-9])", "$1 \u0001")), " \u0001", "")
    from_file = title(F.array_join(kept(F.split(stem, r"[_\-\s]+")), " "))
    whole = title(F.regexp_replace(stem, "_", " "))
    return files.join(first, "file_id", "left").select("file_id", F.coalesce(F.get(names, F.lit(0)), F.when(from_file != "", from_file), whole).alias("entity_name"))


#: Length of the parts of slugs that names are looked up by.
GRAM = 5


def same_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """names (file_id, entity_name), with the name of a known entity (entity_id, entity_name, entity_slug) where it has the same letters and digits, or its slug is part of the name's; the first entity wins.

    A slug is looked up by the one of its parts of GRAM characters (itself, if it is shorter) that the fewest names
    have, and only names with that part are held against it, so no name meets all entities. Entities without a slug and
    names that are null fit nothing.
    """
    squeezed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    have = known.where("entity_slug <> ''").select("entity_id", F.col("entity_name").alias("known"), "entity_slug", squeezed(F.col("entity_name")).alias("plain"))
    slugs = names.where("entity_name IS NOT NULL").select("file_id", slugify(F.col("entity_name")).alias("slug"), squeezed(F.col("entity_name")).alias("plain"))

    def grams(c: Column, size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(c) - (size - 1), F.lit(1)))
        return F.filter(F.transform(starts, lambda k: F.substring(c, k, F.lit(size))), lambda g: F.length(g) == size)

    every = F.array_distinct(F.concat(*[grams(F.col("slug"), k) for k in range(1, GRAM + 1)]))
    of_names = slugs.select("file_id", "slug", F.explode(every).alias("gram"))
    counts = of_names.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("entity_slug") >= GRAM, F.array_distinct(grams(F.col("entity_slug"), GRAM))).otherwise(F.array("entity_slug"))
    rarest = have.select("entity_id", "known", "entity_slug", F.explode(own).alias("gram")).join(counts, "gram", "left")
    rarest = rarest.groupBy("entity_id", "known", "entity_slug").agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("best")).select("entity_id", "known", "entity_slug", "best.gram")
    within = of_names.join(rarest, "gram").where(F.col("slug").contains(F.col("entity_slug"))).select("file_id", "entity_id", "known")
    alike = slugs.join(have, "plain").select("file_id", "entity_id", "known")
    best = within.unionAll(alike).groupBy("file_id").agg(F.min_by("known", "entity_id").alias("known"))
    return names.join(best, "file_id", "left").select("file_id", F.coalesce("known", "entity_name").alias("entity_name"))


def stage(facts: DataFrame, files: DataFrame, last_id: int = 0) -> DataFrame:
    """Facts with the entity of their file and staging ids that depend only on where a fact stands. The files of a load are
    few next to its facts: ids count within a file, after the sizes of the files before it."""
    sizes = facts.groupBy("file_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("file_id", (before + last_id).alias("base"))
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("sheet", "row_idx", "col_idx"))
    rows = facts.withColumn("nth", nth).join(if_small(bases), "file_id").join(if_small(files.select("file_id", "entity_id")), "file_id")
    return rows.withColumn("staging_id", F.col("base") + F.col("nth")).withColumnRenamed("sheet", "source_sheet").drop("base", "nth")
