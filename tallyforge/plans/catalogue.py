"""Catalogue of queries over the driver's tables, with the same results in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import periods, units
from ..functions import text as fn
from ..functions.aliases import resolve_headers
from ..operators import derive as kpi
from ..operators import gates, ingest, mapper, reconcile, router, tools, validate
from ..operators import text as docs
from ..operators.store import Store, scratch, shared_dir
from ..registry import ALIASES, METRICS
from ..sources import documents, samples, sheets
from ..streaming import landing
from . import facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *, with_facts: bool = False) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (facts.SQL if with_facts else "") + sql
        return f

    return put


def number(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


# ---- derived metrics (REC5-7, JON3)

@query(
    """, p AS (
  SELECT entity_slug, period, max(value_normalised) FILTER (canonical_field = 'revenue_net') AS net, max(value_normalised) FILTER (canonical_field = 'cogs') AS cogs FROM live GROUP BY ALL)
SELECT 'f_' || entity_slug || '_' || period || '_gross_profit' AS fact_id, 'gross_profit' AS canonical_field, period, CAST(net - cogs AS DOUBLE) AS value, 'revenue_net,cogs' AS derived_from
FROM p WHERE net IS NOT NULL AND cogs IS NOT NULL
UNION ALL SELECT 'f_' || entity_slug || '_' || period || '_gross_margin_pct', 'gross_margin_pct', period, round(CAST(net - cogs AS DOUBLE) * 100 / CAST(net AS DOUBLE), 4), 'gross_profit,revenue_net'
FROM p WHERE net <> 0 AND cogs IS NOT NULL""",
    with_facts=True,
)
def fiscal_pnl_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kpi.derive(facts.live(spark, sf_dir))
    return made.select("fact_id", "canonical_field", "period", number("value_normalised").alias("value"), F.array_join("derived_from", ",").alias("derived_from"))


@query("SELECT entity_id, period, CAST(revenue_net - cogs AS DOUBLE) AS gross_profit FROM (SELECT entity_id, period, max(value_normalised) FILTER (canonical_field = 'revenue_net') AS revenue_net, max(value_normalised) FILTER (canonical_field = 'cogs') AS cogs FROM live GROUP BY ALL)", with_facts=True)
def derived_gross_profit(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kpi.wide(facts.live(spark, sf_dir), ["revenue_net", "cogs"])
    return t.select("entity_id", "period", number(kpi.apply_formula("difference", F.col("revenue_net"), F.col("cogs"))).alias("gross_profit"))


@query("SELECT a.entity_id, a.period, round(CAST(a.value_normalised AS DOUBLE) * 100 / CAST(b.value_normalised AS DOUBLE), 4) AS return_share_pct FROM live a JOIN live b USING (entity_id, period) WHERE a.canonical_field = 'returns_refunds' AND b.canonical_field = 'revenue_gross' AND b.value_normalised <> 0", with_facts=True)
def derived_ratio_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = kpi.wide(facts.live(spark, sf_dir), ["returns_refunds", "revenue_gross"])
    share = kpi.apply_formula("percent", F.col("returns_refunds"), F.col("revenue_gross"))
    return t.where("revenue_gross <> 0").select("entity_id", "period", number(share).alias("return_share_pct"))


@query("SELECT entity_id, period, CAST(value_normalised AS DOUBLE) AS divisor FROM live WHERE canonical_field = 'returns_refunds' AND (entity_id % 2 = 0 OR value_normalised = 0)", with_facts=True)
def derived_zero_divisor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ratios are left out: every other entity's returns count as zero."""
    live = facts.live(spark, sf_dir)
    t = kpi.wide(live, ["returns_refunds", "revenue_net"])
    zeroed = F.when(F.col("entity_id") % 2 == 0, F.lit(0).cast("decimal(28,6)")).otherwise(F.col("returns_refunds"))
    return t.where(kpi.apply_formula("percent", F.col("revenue_net"), zeroed).isNull()).select("entity_id", "period", number("returns_refunds").alias("divisor"))


# ---- periods (FN1, FN2)


@query("SELECT o_orderkey, 'FY' || lpad(CAST((year(o_orderdate) + CAST(month(o_orderdate) >= 4 AS INTEGER)) % 100 AS VARCHAR), 2, '0') AS fiscal_year, 'FY' || lpad(CAST((year(o_orderdate) + CAST(month(o_orderdate) >= 4 AS INTEGER)) % 100 AS VARCHAR), 2, '0') || '-M' || lpad(CAST((month(o_orderdate) + 8) % 12 + 1 AS VARCHAR), 2, '0') AS fiscal_month, 'FY' || lpad(CAST((year(o_orderdate) + CAST(month(o_orderdate) >= 4 AS INTEGER)) % 100 AS VARCHAR), 2, '0') || '-Q' || CAST(((month(o_orderdate) + 8) % 12) // 3 + 1 AS VARCHAR) AS fiscal_quarter FROM orders")
def fiscal_period_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return facts.table(spark, sf_dir, "orders").select("o_orderkey", periods.period_of(d).alias("fiscal_year"), periods.period_of(d, "month").alias("fiscal_month"), periods.period_of(d, "quarter").alias("fiscal_quarter"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'FY' || fy WHEN 1 THEN 'FY' || fy || '-M' || lpad(CAST((m + 8) % 12 + 1 AS VARCHAR), 2, '0') WHEN 2 THEN 'FY' || fy WHEN 3 THEN 'FY' || fy || '-Q' || CAST(((m + 8) % 12) // 3 + 1 AS VARCHAR) ELSE 'CY' || CAST(y AS VARCHAR) END AS period
FROM (SELECT *, lpad(CAST((y + CAST(m >= 4 AS INTEGER)) % 100 AS VARCHAR), 2, '0') AS fy FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders))""")
def period_parse_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in five notations and read back."""
    d = F.col("o_orderdate")
    q = F.ceil((F.pmod(F.month(d) + 8, F.lit(12)) + 1) / 3)
    fy = F.year(d) + (F.month(d) >= 4).cast("int")
    written = (
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("FY "), (fy - 1).cast("string"), F.lit("-"), F.substring(fy.cast("string"), 3, 2)))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(d, "MMM-yy"))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(F.lit("1-Apr-98 to "), F.date_format(d, "dd.MM.yyyy")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("q"), q.cast("string"), F.lit(" fy"), fy.cast("string")))
        .otherwise(F.concat(F.lit("CY "), F.year(d).cast("string")))
    )
    return facts.table(spark, sf_dir, "orders").select("o_orderkey", periods.parse_period(written).alias("period"))


@query("""SELECT DISTINCT 'FY' || lpad(CAST(fy % 100 AS VARCHAR), 2, '0') || ' (Apr ' || CAST(2000 + (fy % 100) - 1 AS VARCHAR) || '–Mar ' || CAST(2000 + (fy % 100) AS VARCHAR) || ')' AS label FROM (SELECT year(o_orderdate) + CAST(month(o_orderdate) >= 4 AS INTEGER) AS fy FROM orders)""")
def period_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table(spark, sf_dir, "orders").select(periods.period_of(F.col("o_orderdate")).alias("p")).distinct().select(periods.period_label(F.col("p")).alias("label"))


# ---- units and numbers (FN3-FN6)

_UNITS = ["Rs. Crore", "INR lakh", "USD million", "usd '000", "rupees", "$bn", "figures", "All figures in Rs. Lakhs", "INR Million", "in USD"]
_UNIT_SQL = ", ".join(f"({i}, {f})" for i, f in enumerate([10_000_000, 100_000, 1_000_000, 1_000, 1, 1_000_000_000, 1, 100_000, 1_000_000, 1]))


@query(f"SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * factor AS DOUBLE) AS value, CAST(factor AS BIGINT) AS factor FROM part JOIN (VALUES {_UNIT_SQL}) u(k, factor) ON p_partkey % 10 = k")
def unit_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("p_partkey") % 10 + 1).cast("int"))
    n = units.normalise(F.col("p_retailprice").cast("decimal(18,2)"), unit)
    return facts.table(spark, sf_dir, "part").select("p_partkey", n.alias("n")).select("p_partkey", number("n.value").alias("value"), F.col("n.factor").alias("factor"))


@query("SELECT s_suppkey, CASE WHEN abs(v) >= 1e7 THEN '₹' || printf('%.2f', v / 1e7) || ' Cr' WHEN abs(v) >= 1e5 THEN '₹' || printf('%.2f', v / 1e5) || ' L' ELSE '₹' || format('{:,.0f}', v) END AS shown FROM (SELECT s_suppkey, round(s_acctbal) * CASE s_suppkey % 3 WHEN 0 THEN 10000 WHEN 1 THEN 100 ELSE 1 END AS v FROM supplier)")
def display_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances in rupees; one that is rounded to nothing from below zero keeps its sign, which Spark's rounding drops."""
    v = F.signum("s_acctbal") * F.round(F.abs("s_acctbal")) * F.when(F.col("s_suppkey") % 3 == 0, 10000).when(F.col("s_suppkey") % 3 == 1, 100).otherwise(1)
    return facts.table(spark, sf_dir, "supplier").select("s_suppkey", units.display(v, F.lit("INR")).alias("shown"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'INR absolute' WHEN 1 THEN 'INR crore' WHEN 2 THEN 'INR absolute' ELSE NULL END AS unit FROM part""")
def row_unit_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    label = F.when(F.col("p_partkey") % 4 == 0, F.concat(name, F.lit(" (Rs absolute)"))).when(F.col("p_partkey") % 4 == 1, F.concat(name, F.lit(" (crore)")))
    label = label.when(F.col("p_partkey") % 4 == 2, F.concat(name, F.lit(" in Rs"))).otherwise(name)
    return facts.table(spark, sf_dir, "part").select("p_partkey", units.row_unit(label, F.lit("INR Lakh")).alias("unit"))


@query("SELECT l_orderkey, l_linenumber, CASE (l_orderkey + l_linenumber) % 5 WHEN 0 THEN -v WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE v END AS value FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS v FROM lineitem)")
def numeric_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2)
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 5
    written = F.when(k == 0, F.concat(F.lit("("), shown, F.lit(")"))).when(k == 1, "N/A").when(k == 2, F.concat(shown, F.lit("% (calc)"))).otherwise(F.concat(F.lit(" "), shown))
    return facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fn.parse_number(written).alias("value"))


@query("SELECT s_suppkey, (CASE WHEN s_suppkey <= 26 THEN chr(CAST(64 + s_suppkey AS INTEGER)) WHEN s_suppkey <= 702 THEN chr(CAST(64 + (s_suppkey - 1) // 26 AS INTEGER)) || chr(CAST(65 + (s_suppkey - 1) % 26 AS INTEGER)) ELSE chr(CAST(65 + (s_suppkey - 703) // 676 AS INTEGER)) || chr(CAST(65 + ((s_suppkey - 703) // 26) % 26 AS INTEGER)) || chr(CAST(65 + (s_suppkey - 703) % 26 AS INTEGER)) END) || CAST(s_suppkey + 1 AS VARCHAR) AS cell FROM supplier")
def cell_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table(spark, sf_dir, "supplier").select("s_suppkey", fn.cell_reference(F.col("s_suppkey"), F.col("s_suppkey") + 1).alias("cell"))


# ---- headers (FN10, FN12)

_HEADERS = [*ALIASES, "Total Debtor (net)", "Monthly Freight and Delivery", "staff wages", "Quarterly Office Rent", "unrelated words here", "Raw material"]
_EXPECTED = [*ALIASES.values(), "accounts_receivable", "logistics_expense", "salary_expense", "rent_expense", None, "cogs"]
_ALIAS_SQL = ", ".join(f"({i}, {'NULL' if m is None else repr(m)})" for i, m in enumerate(_EXPECTED))


@query(f"SELECT p_partkey, metric FROM part JOIN (VALUES {_ALIAS_SQL}) a(k, metric) ON p_partkey % {len(_HEADERS)} = k")
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("p_partkey") % len(_HEADERS) + 1).cast("int"))
    rows = facts.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), F.upper(header)).alias("header"))
    return rows.join(resolve_headers(rows, "header"), "header").select("p_partkey", "metric")


@query("SELECT entity_id, entity_slug, 'f_' || entity_slug || '_FY00_' || 'cogs' AS fact_id FROM slugs", with_facts=True)
def slug_and_fact_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.slugs(spark, sf_dir).select("entity_id", "entity_slug", fn.fact_id(F.col("entity_slug"), F.lit("FY00"), F.lit("cogs")).alias("fact_id"))


# ---- sheets to facts (RSH1-7, SRC2-5, FN7, FN11, FN14)

_LINES = (("Gross Revenue", "gross"), ("Returns/Refunds", "returns"), ("COGS", "cogs"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of every entity and fiscal year, with the year's place among all years; computed once."""
    f = scratch(facts.sums(spark, sf_dir), "sums")
    years = f.select("fiscal_year").distinct().withColumn("nth", (F.row_number().over(Window.orderBy("fiscal_year")) - 1).cast("int"))
    return f.join(F.broadcast(years), "fiscal_year")  # a row for each year


def _sheet(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Cells of one sheet for each nation (ledger: and year), as a reader of sheets gives them."""
    lines = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(h).alias("h"), F.col(c).alias("v")) for k, (h, c) in enumerate(_LINES)])
    f = _yearly(spark, sf_dir).select("entity_id", "period", "nth", F.explode(lines).alias("m")).select("entity_id", "period", "nth", "m.*")
    raw = F.format_number(F.round(F.col("v"), 2), 2)
    ids = [(F.col("entity_id") * 1000 + (F.col("nth") if layout == "ledger" else 0)).alias("file_id"), F.lit("S1").alias("sheet")]
    if layout == "tall":
        label = f.select(*ids, F.col("nth").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Period").alias("header"), F.col("period").alias("raw")).distinct()
        cells = f.select(*ids, F.col("nth").alias("row_idx"), (F.col("k") + 1).alias("col_idx"), F.col("h").alias("header"), raw.alias("raw"))
    else:
        label = f.select(*ids, F.col("k").alias("row_idx"), F.lit(0).alias("col_idx"), F.lit("Particulars" if layout == "ledger" else "Metric").alias("header"), F.col("h").alias("raw")).distinct()
        place, header = (F.lit(1), F.lit("Amount")) if layout == "ledger" else (F.col("nth") + 1, F.col("period"))
        cells = f.select(*ids, F.col("k").alias("row_idx"), place.alias("col_idx"), header.alias("header"), raw.alias("raw"))
    return scratch(label.union(cells), "cells")


def _facts_of(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    made = ingest.extract(_sheet(spark, sf_dir, layout), spark.createDataFrame([], "file_id int, sheet string, unit string"))
    entity = F.floor(F.col("file_id") / 1000).cast("int")
    return made.select(entity.alias("entity_id"), "canonical_field", "period", F.round(number("value_normalised"), 2).alias("value"), "layout")


_SHEET_SQL = """SELECT entity_id, canonical_field, {period} AS period, CAST(round(value_normalised, 2) AS DOUBLE) AS value, '{layout}' AS layout FROM live WHERE canonical_field <> 'revenue_net'"""


@query(_SHEET_SQL.format(period="period", layout="wide"), with_facts=True)
def wide_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts_of(spark, sf_dir, "wide")


@query(_SHEET_SQL.format(period="period", layout="tall"), with_facts=True)
def tall_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts_of(spark, sf_dir, "tall")


@query(_SHEET_SQL.format(period="'FY24'", layout="ledger"), with_facts=True)
def ledger_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts_of(spark, sf_dir, "ledger")


def _files_of(rows: DataFrame, kind: str, build: Callable[[dict], bytes]) -> DataFrame:
    """A file (file_id, file_type, content) for each row, whose first column is its number."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            made = [build(row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * len(made)), pa.array(made, pa.binary())], ["file_id", "file_type", "content"])

    return rows.mapInArrow(run, "file_id int, file_type string, content binary")


def _workbook_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """A real file (file_id, file_type, content) for each nation: lone lines above the header, a rule, a blank and a total among its rows, notes beside them."""
    f = _yearly(spark, sf_dir)
    n_years = f.agg(F.max("nth")).first()[0]
    shown = [F.format_number(F.round(F.col(c), 2), 2).alias(c) for _, c in _LINES]
    whole = f.groupBy(F.col("entity_id").alias("file_id")).agg(F.collect_list(F.struct("nth", "period", *shown)).alias("years"), F.first("entity_id").alias("entity_id"))
    whole = whole.join(F.broadcast(facts.slugs(spark, sf_dir)), "entity_id").select("file_id", "years", "entity_name")
    names = {r["nth"]: r["period"] for r in f.select("nth", "period").distinct().collect()}

    def build(row: dict) -> bytes:
        by_year = {y["nth"]: y for y in row["years"]}
        line = lambda label, column, note: [label, *(by_year[k][column] if k in by_year else "" for k in range(n_years + 1)), note]
        empty = [""] * (n_years + 1)
        rows = [[f"{row['entity_name']} Holdings - P&L"], ["All figures in Rs. Lakhs"], ["Metric", *(names[k] for k in range(n_years + 1)), "Notes"], ["--- income ---", *empty, ""]]
        rows += [line(_LINES[0][0], _LINES[0][1], "margin 5%"), ["", *empty, ""], line(_LINES[1][0], _LINES[1][1], ""), line(_LINES[2][0], _LINES[2][1], "as reported"), ["Total", *(["9"] * (n_years + 1)), ""]]
        return samples.to_csv(rows) if kind == ".csv" else samples.to_xlsx({"S1": rows}) if kind == ".xlsx" else samples.to_xls({"S1": rows})

    return _files_of(whole, kind, build)


def _workbooks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The grid of each nation's file."""
    return scratch(sheets.read_grid(_workbook_files(spark, sf_dir, kind)).where("error IS NULL").drop("error"), "grid")


def _workbook_facts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    grid = _workbooks(spark, sf_dir, kind)
    about = scratch(ingest.discover(grid), "sheets")
    return ingest.extract(scratch(ingest.cells(grid, about), "cells"), about.select("file_id", "sheet", "unit"))


def _read(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    made = _workbook_facts(spark, sf_dir, kind)
    return made.select(F.col("file_id").alias("entity_id"), "canonical_field", "period", number("value_normalised").alias("value"), "currency", "original_unit", "cell_reference")


_WORKBOOK_SQL = """, y AS (SELECT fiscal_year, CAST(row_number() OVER (ORDER BY fiscal_year) AS INTEGER) AS place FROM (SELECT DISTINCT fiscal_year FROM live)),
w AS (SELECT live.*, chr(65 + place) || CASE canonical_field WHEN 'revenue_gross' THEN '5' WHEN 'returns_refunds' THEN '7' ELSE '8' END AS cell_reference, place FROM live JOIN y USING (fiscal_year) WHERE canonical_field <> 'revenue_net')
"""
_READ_SQL = _WORKBOOK_SQL + "SELECT entity_id, canonical_field, period, CAST(round(value_normalised, 2) * 100000 AS DOUBLE) AS value, 'INR' AS currency, 'INR Lakh' AS original_unit, cell_reference FROM w"


@query(_READ_SQL, with_facts=True)
def csv_files_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, ".csv")


@query(_READ_SQL, with_facts=True)
def xlsx_files_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, ".xlsx")


@query(_READ_SQL, with_facts=True)
def xls_files_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, ".xls")


@query(_WORKBOOK_SQL + "SELECT entity_id, cell_reference, row_number() OVER (ORDER BY entity_id, CAST(substr(cell_reference, 2) AS INTEGER), place) AS staging_id FROM w", with_facts=True)
def staging_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = facts.slugs(spark, sf_dir).select(F.col("entity_id").alias("file_id"), "entity_id")
    return ingest.stage(_workbook_facts(spark, sf_dir, ".csv"), files).select("entity_id", "cell_reference", F.col("staging_id").cast("long").alias("staging_id"))


@query("SELECT DISTINCT entity_id AS file_id, 2 AS header_row, 'All figures in Rs. Lakhs' AS unit, 2 AS lines_above, 'wide' AS layout FROM live", with_facts=True)
def sheet_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _workbooks(spark, sf_dir, ".csv")
    about = scratch(ingest.discover(grid), "sheets")
    laid = ingest.layouts(ingest.cells(grid, about)).select("file_id", "layout")
    return about.join(laid, "file_id").select("file_id", "header_row", "unit", F.size("preamble").alias("lines_above"), "layout")


@query("SELECT e.entity_id AS file_id, row_idx, raw_text, claims FROM (SELECT DISTINCT entity_id FROM live) e, (VALUES (1, 'margin 5%', true), (4, 'as reported', false)) n(row_idx, raw_text, claims)", with_facts=True)
def sheet_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = _workbooks(spark, sf_dir, ".csv")
    notes = ingest.annotations(ingest.cells(grid, ingest.discover(grid)))
    return notes.select("file_id", F.col("chunk_index").alias("row_idx"), "raw_text", F.col("contains_numerical_claim").alias("claims"))


@query("SELECT DISTINCT entity_id AS file_id, CASE WHEN entity_id >= 10 THEN 'NATION Holdings' ELSE 'NATION ' || CAST(entity_id AS VARCHAR) || ' Holdings' END AS entity_name FROM live", with_facts=True)
def sheet_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the lines above the headers; numbers of two digits and more are no part of a name."""
    about = ingest.discover(_workbooks(spark, sf_dir, ".csv"))
    files = about.select("file_id").distinct().withColumn("filename", F.lit("x.csv"))
    return ingest.entity_names(about, files)


@query("SELECT n_nationkey AS file_id, min(m.n_name) AS entity_name FROM nation n JOIN (SELECT arg_min(k.n_name, k.n_nationkey) AS n_name, n.n_nationkey AS key FROM nation n JOIN nation k ON contains(lower(n.n_name) || '_report', lower(k.n_name)) GROUP BY n.n_nationkey) m ON m.key = n.n_nationkey GROUP BY n_nationkey")
def document_entity_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents find their entities by name: the first whose slug their own name holds."""
    names = facts.slugs(spark, sf_dir).select(F.col("entity_id").alias("file_id"), F.concat("entity_name", F.lit(" report")).alias("entity_name"))
    return ingest.same_names(names, facts.slugs(spark, sf_dir))


@query("SELECT DISTINCT sha256(text) AS checksum FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)")
def new_files_by_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = facts.table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("checksum"))
    return sheets.new_files(files, files.where("doc_id % 3 = 0")).select("checksum")


@query("SELECT p_partkey, md5(lower(trim(p_name))) AS header_key FROM part")
def header_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.table(spark, sf_dir, "part").select("p_partkey", mapper.header_key(F.concat(F.lit(" "), F.upper("p_name"))).alias("header_key"))


# ---- Word documents and pages (SRC6-8, RSH8)

_PROSE = "reports that demand held up in all of its markets and that prices rose a little faster than the cost of goods over the whole of the year"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Word document for each nation: headings, a long and a short paragraph, a table of facts and one of other things."""

    def build(row: dict) -> bytes:
        k = row["file_id"]
        return samples.to_docx(["# Overview", f"{row['entity_name']} {_PROSE}", "* not audited", "# Tables", [["Period", "Inventory", "Total debt"], ["FY23", str(k + 1), "7"], ["FY24", str(k + 2), "8"]], [["Category", "Amount"], ["a", str(k)]]])

    rows = facts.slugs(spark, sf_dir).select(F.col("entity_id").alias("file_id"), "entity_name")
    return scratch(documents.read_parts(_files_of(rows, ".docx", build)).where("error IS NULL").drop("error"), "parts")


@query(f"SELECT CAST(n_nationkey AS INTEGER) AS file_id, i AS chunk_index, kind AS chunk_type, 'Overview' AS section_path, CASE i WHEN 1 THEN n_name || ' {_PROSE}' ELSE '* not audited' END AS raw_text FROM nation, (VALUES (1, 'narrative'), (2, 'footnote')) p(i, kind)")
def word_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.paragraphs(_documents(spark, sf_dir)).select("file_id", "chunk_index", "chunk_type", "section_path", "raw_text")


@query("SELECT CAST(n_nationkey AS INTEGER) AS file_id, metric AS canonical_field, period, CAST(CASE metric WHEN 'inventory' THEN n_nationkey + k ELSE 6 + k END AS DOUBLE) AS value FROM nation, (VALUES ('FY23', 1), ('FY24', 2)) p(period, k), (VALUES ('inventory'), ('total_debt')) m(metric)")
def word_tables_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = scratch(documents.table_grid(_documents(spark, sf_dir)), "grid")
    about = scratch(ingest.discover(grid), "sheets")
    made = ingest.extract(ingest.cells(grid, about), about.select("file_id", "sheet", F.lit("INR absolute").alias("unit")))
    return made.select("file_id", "canonical_field", "period", number("value_normalised").alias("value"))


@query("SELECT CAST(n_nationkey AS INTEGER) AS file_id, 1 AS chunk_index, 'Category | Amount' || chr(10) || 'a | ' || CAST(n_nationkey AS VARCHAR) AS raw_text FROM nation")
def word_tables_to_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.table_chunks(_documents(spark, sf_dir)).select("file_id", "chunk_index", "raw_text")


@query("SELECT p_partkey AS file_id, region AS region_type, CASE region WHEN 'table' THEN 'table' WHEN 'footer_notes' THEN 'footnote' ELSE 'narrative' END AS chunk_type FROM (SELECT p_partkey, CASE WHEN w > 2 * h AND h > 5 THEN 'table' WHEN p_partkey % 3 <> 0 OR y0 > 680 THEN 'footer_notes' ELSE 'narrative' END AS region FROM (SELECT p_partkey, p_size * 10.0 AS w, p_partkey % 40 * 10.0 AS h, p_size * 16.0 AS y0 FROM part))")
def page_block_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = facts.table(spark, sf_dir, "part")
    words = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 15)).otherwise(F.col("p_name"))
    y0 = F.col("p_size") * 16.0
    blocks = p.select(F.col("p_partkey").alias("file_id"), F.lit(1).alias("page"), F.lit(0.0).alias("x0"), y0.alias("y0"), (F.col("p_size") * 10.0).alias("x1"), (y0 + F.col("p_partkey") % 40 * 10.0).alias("y1"), words.alias("text"), F.lit(800.0).alias("page_height"))
    return documents.block_chunks(blocks).select("file_id", "region_type", "chunk_type")


# ---- reconciliation (REC1-4, AGG1, AGG7, AGG8, JON1, JON6, JON7)

_KEY = "entity_id, canonical_field, period"


def _staged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return facts.staging(spark, sf_dir), facts.files(spark)


@query(f"SELECT {_KEY}, count(DISTINCT value_normalised) AS n_values, CAST(max(value_normalised) - min(value_normalised) AS DOUBLE) AS spread FROM staging JOIN files USING (file_id) GROUP BY {_KEY} HAVING count(DISTINCT value_normalised) > 1", with_facts=True)
def detect_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.detect_conflicts(*_staged(spark, sf_dir))
    values = F.transform("options", lambda o: o["value"].cast("decimal(28,6)"))
    return found.select("entity_id", "canonical_field", "period", "n_values", number(F.array_max(values) - F.array_min(values)).alias("spread"))


@query(f"SELECT {_KEY}, string_agg(CAST(staging_id AS VARCHAR) || ':' || filename, ';' ORDER BY staging_id) AS options FROM staging JOIN files USING (file_id) GROUP BY {_KEY} HAVING count(DISTINCT value_normalised) > 1", with_facts=True)
def conflict_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reconcile.detect_conflicts(*_staged(spark, sf_dir))
    shown = F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["staging_id"].cast("string"), o["source"])), ";")
    return found.select("entity_id", "canonical_field", "period", shown.alias("options"))


def _promoted(spark: SparkSession, sf_dir: str, policy: str, pattern: str | None = None) -> DataFrame:
    staging, files = _staged(spark, sf_dir)
    decisions = reconcile.resolve(reconcile.detect_conflicts(staging, files), policy, pattern)
    live = reconcile.promote(staging, decisions, facts.slugs(spark, sf_dir))
    return live.select("fact_id", number("value_normalised").alias("value"), "staging_id", F.col("authoritative_note").isNotNull().alias("contested"))


_PROMOTE = """, k AS (SELECT {key}, count(DISTINCT value_normalised) > 1 AS contested, {pick} AS staging_id FROM staging GROUP BY {key})
SELECT 'f_' || entity_slug || '_' || k.period || '_' || k.canonical_field AS fact_id, CAST(s.value_normalised AS DOUBLE) AS value, k.staging_id, contested
FROM k JOIN staging s USING (staging_id) JOIN slugs ON slugs.entity_id = k.entity_id"""


@query(_PROMOTE.format(key=_KEY, pick="min(staging_id)"), with_facts=True)
def promote_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promoted(spark, sf_dir, "first")


@query(_PROMOTE.format(key=_KEY, pick="CASE WHEN count(DISTINCT value_normalised) > 1 THEN max(staging_id) ELSE min(staging_id) END"), with_facts=True)
def promote_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promoted(spark, sf_dir, "prefer", "audited")


@query(_PROMOTE.format(key=_KEY, pick="min(staging_id)") + " WHERE NOT contested", with_facts=True)
def promote_skips_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _promoted(spark, sf_dir, "open")


@query("""SELECT entity_id, canonical_field, period, string_agg(CAST(staging_id AS VARCHAR), ',' ORDER BY staging_id) AS ids FROM staging GROUP BY ALL HAVING count(DISTINCT value_normalised) > 1""", with_facts=True)
def conflicts_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts within two files, a third that contradicts everything being left out."""
    staging, files = _staged(spark, sf_dir)
    third = staging.where("file_id = 1").withColumn("file_id", F.lit(3)).withColumn("staging_id", -F.col("staging_id")).withColumn("value_normalised", (F.col("value_normalised") + 5).cast("decimal(28,6)"))
    found = reconcile.detect_conflicts(staging.union(third), files.union(spark.createDataFrame([(3, "other.csv")], files.schema)), file_ids=[1, 2])
    return found.select("entity_id", "canonical_field", "period", F.array_join(F.transform("staging_ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT 'f_' || entity_slug || '_' || period || '_' || canonical_field AS fact_id, CAST(value_normalised AS DOUBLE) AS value FROM staging JOIN slugs USING (entity_id) WHERE file_id = 2", with_facts=True)
def promote_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    staging, files = _staged(spark, sf_dir)
    decisions = reconcile.resolve(reconcile.detect_conflicts(staging, files, file_ids=[2]))
    return reconcile.promote(staging, decisions, facts.slugs(spark, sf_dir), file_ids=[2]).select("fact_id", number("value_normalised").alias("value"))


@query(f""", c AS (SELECT {_KEY}, count(DISTINCT value_normalised) > 1 AS contested, min(staging_id) AS first, max(staging_id) AS last FROM staging GROUP BY {_KEY})
SELECT 'f_' || entity_slug || '_' || period || '_' || canonical_field AS fact_id, CASE WHEN contested AND entity_id % 2 = 0 THEN last ELSE first END AS staging_id FROM c JOIN slugs USING (entity_id) WHERE NOT contested OR entity_id % 2 = 0""", with_facts=True)
def promote_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users have settled the conflicts of every other entity, the others are open."""
    staging, files = _staged(spark, sf_dir)
    conflicts = reconcile.detect_conflicts(staging, files)
    said = conflicts.where("entity_id % 2 = 0").select(*reconcile.KEY, F.element_at("staging_ids", -1).alias("resolution_staging_id"), F.lit("user").alias("resolved_by"))
    decisions = reconcile.settled(reconcile.resolve(conflicts, "open"), said).drop("resolved_by")
    return reconcile.promote(staging, decisions, facts.slugs(spark, sf_dir)).select("fact_id", "staging_id")


@query("""SELECT 'f_' || n.entity_slug || '_' || n.period || '_' || m AS fact_id, n.staging_id, 1 AS source_file_id FROM live n JOIN live c USING (entity_id, period), (VALUES ('gross_profit'), ('gross_margin_pct')) m(m)
WHERE n.canonical_field = 'revenue_net' AND c.canonical_field = 'cogs' AND (m = 'gross_profit' OR n.value_normalised <> 0)""", with_facts=True)
def derived_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = kpi.derive(facts.live(spark, sf_dir).withColumnRenamed("file_id", "source_file_id"))
    return made.select("fact_id", "staging_id", "source_file_id")


@query("SELECT entity_id, count(*) AS n, CAST(sum(CASE WHEN entity_id % 2 = 0 THEN 2 * value_normalised ELSE value_normalised END) AS DOUBLE) AS total FROM live GROUP BY entity_id", with_facts=True)
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live facts appended to a store, the partitions of every other entity replaced, and all read back."""
    store, live = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), scratch(facts.live(spark, sf_dir), "live")
    store.append("live_facts", live)
    store.overwrite("live_facts", live.where("entity_id % 2 = 0").withColumn("value_normalised", (F.col("value_normalised") * 2).cast("decimal(28,6)")))
    return store.read("live_facts").groupBy("entity_id").agg(F.count("*").alias("n"), number(F.sum("value_normalised")).alias("total"))


# ---- validation (VAL1-7, WIN1)


def _perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live facts with some values that the checks must find."""
    f, e = F.col("canonical_field"), F.col("entity_id")
    v = F.col("value_normalised")
    v = F.when((f == "revenue_net") & (e % 4 == 0), v * 2).when((f == "cogs") & (e % 5 == 0), v / 1000000000).when((f == "revenue_net") & (e % 5 == 1), -v).when((f == "revenue_gross") & (F.col("fiscal_year") % 3 == 0), v / 20).otherwise(v)
    return facts.live(spark, sf_dir).withColumn("value_normalised", v.cast("decimal(28,6)"))


_PERTURBED = """, facts_ AS (SELECT * REPLACE (CAST(CASE WHEN canonical_field = 'revenue_net' AND entity_id % 4 = 0 THEN value_normalised * 2 WHEN canonical_field = 'cogs' AND entity_id % 5 = 0 THEN value_normalised / 1000000000
  WHEN canonical_field = 'revenue_net' AND entity_id % 5 = 1 THEN -value_normalised WHEN canonical_field = 'revenue_gross' AND fiscal_year % 3 = 0 THEN value_normalised / 20 ELSE value_normalised END AS DECIMAL(28,6)) AS value_normalised) FROM live)
"""


def _shown(issues: DataFrame) -> DataFrame:
    return issues.select("check", "severity", "entity_id", "canonical_field", "period")


@query(_PERTURBED + """SELECT 'sum_relation' AS "check", 'warning' AS severity, g.entity_id, 'revenue_net' AS canonical_field, g.period FROM facts_ g LEFT JOIN facts_ r ON r.entity_id = g.entity_id AND r.period = g.period AND r.canonical_field = 'returns_refunds'
JOIN facts_ n ON n.entity_id = g.entity_id AND n.period = g.period AND n.canonical_field = 'revenue_net' WHERE g.canonical_field = 'revenue_gross' AND g.value_normalised - coalesce(r.value_normalised, 0) <> 0
AND CAST(abs(n.value_normalised - (g.value_normalised - coalesce(r.value_normalised, 0))) AS DOUBLE) / CAST(abs(g.value_normalised - coalesce(r.value_normalised, 0)) AS DOUBLE) > 0.05""", with_facts=True)
def validate_sum_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(validate.sum_relation(_perturbed(spark, sf_dir)))


@query("""SELECT 'margin_consistency' AS "check", 'warning' AS severity, entity_id, 'gross_margin_pct' AS canonical_field, period FROM (SELECT entity_id, period, max(value_normalised) FILTER (canonical_field = 'revenue_net') AS net, max(value_normalised) FILTER (canonical_field = 'cogs') AS cogs FROM live GROUP BY ALL) WHERE net > 0 AND entity_id % 3 = 0""", with_facts=True)
def validate_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margins as derived, two points too high for every third entity."""
    live = facts.live(spark, sf_dir).select("entity_id", "entity_slug", "canonical_field", "period", "value_normalised")
    made = kpi.derive(live).select("entity_id", "entity_slug", "canonical_field", "period", "value_normalised")
    off = F.when((F.col("canonical_field") == "gross_margin_pct") & (F.col("entity_id") % 3 == 0), F.col("value_normalised") + 2).otherwise(F.col("value_normalised"))
    return _shown(validate.margin_consistency(live.union(made.withColumn("value_normalised", off.cast("decimal(28,6)")))))


@query(_PERTURBED + """SELECT 'magnitude' AS "check", CASE WHEN CAST(value_normalised AS DOUBLE) > 1e12 THEN 'error' ELSE 'warning' END AS severity, entity_id, canonical_field, period FROM facts_ WHERE canonical_field IN ('revenue_gross', 'revenue_net', 'cogs') AND (CAST(value_normalised AS DOUBLE) > 1e12 OR CAST(value_normalised AS DOUBLE) < 1e3)""", with_facts=True)
def validate_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(validate.magnitude(_perturbed(spark, sf_dir)))


@query(_PERTURBED + """, l AS (SELECT *, lag(value_normalised) OVER (PARTITION BY entity_id, canonical_field ORDER BY fiscal_year) AS last FROM facts_ WHERE canonical_field IN ('revenue_net', 'revenue_gross', 'ebitda', 'pat'))
SELECT 'period_swing' AS "check", 'warning' AS severity, entity_id, canonical_field, period FROM l WHERE last <> 0 AND value_normalised <> 0 AND (abs(CAST(value_normalised AS DOUBLE) / CAST(last AS DOUBLE)) > 10 OR abs(CAST(value_normalised AS DOUBLE) / CAST(last AS DOUBLE)) < 0.1)""", with_facts=True)
def validate_period_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(validate.period_swing(_perturbed(spark, sf_dir)))


@query(_PERTURBED + """SELECT 'sign' AS "check", 'warning' AS severity, entity_id, canonical_field, period FROM facts_ WHERE canonical_field IN ('revenue_net', 'revenue_gross') AND value_normalised < -1000""", with_facts=True)
def validate_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(validate.sign(_perturbed(spark, sf_dir)))


@query(_PERTURBED + """, i AS (
  SELECT 'magnitude' AS "check", CASE WHEN CAST(value_normalised AS DOUBLE) > 1e12 THEN 1 ELSE 0 END AS error FROM facts_ WHERE canonical_field IN ('revenue_gross', 'revenue_net', 'cogs') AND (CAST(value_normalised AS DOUBLE) > 1e12 OR CAST(value_normalised AS DOUBLE) < 1e3)
  UNION ALL SELECT 'sign', 0 FROM facts_ WHERE canonical_field IN ('revenue_net', 'revenue_gross') AND value_normalised < -1000)
SELECT c AS "check", CAST(coalesce(sum(error), 0) AS BIGINT) AS errors, CAST(count(error) - coalesce(sum(error), 0) AS BIGINT) AS warnings, coalesce(sum(error), 0) = 0 AS passed
FROM (VALUES ('sum_relation'), ('margin_consistency'), ('magnitude'), ('period_swing'), ('sign')) v(c) LEFT JOIN i ON i."check" = c GROUP BY c""", with_facts=True)
def validate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the checks found something, the others passed."""
    rows = _perturbed(spark, sf_dir)
    return validate.summary(validate.magnitude(rows).union(validate.sign(rows)))


@query("""SELECT 'sum_relation' AS "check", entity_id, period FROM (SELECT entity_id, period, max(value_normalised) FILTER (canonical_field = 'revenue_gross') AS g, max(value_normalised) FILTER (canonical_field = 'returns_refunds') AS r,
  max(value_normalised * CASE WHEN entity_id % 2 = 0 THEN 2 ELSE 3 END) FILTER (canonical_field = 'revenue_net') AS n FROM live GROUP BY entity_id, period)
WHERE g - coalesce(r, 0) <> 0 AND CAST(abs(n - (g - coalesce(r, 0))) AS DOUBLE) / CAST(abs(g - coalesce(r, 0)) AS DOUBLE) > 0.05""", with_facts=True)
def validate_staged_or_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations are checked on staged facts (net revenue doubled) of the entities that have them, on live ones (tripled) of the others."""
    rows = facts.live(spark, sf_dir)
    off = lambda k: F.when(F.col("canonical_field") == "revenue_net", F.col("value_normalised") * k).otherwise(F.col("value_normalised")).cast("decimal(28,6)")
    issues = validate.validate(rows.where("entity_id % 2 = 0").withColumn("value_normalised", off(2)), live=rows.withColumn("value_normalised", off(3)), file_ids=[1])
    return issues.where("check = 'sum_relation'").select("check", "entity_id", "period")


def _filed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged facts, files and open conflicts, with two files of its own for each entity."""
    staging = facts.staging(spark, sf_dir).withColumn("file_id", (F.col("entity_id") * 10 + F.col("file_id")).cast("int"))
    both = F.explode(F.array(F.lit(1), F.lit(2)))
    files = facts.slugs(spark, sf_dir).withColumn("k", both).select((F.col("entity_id") * 10 + F.col("k")).cast("int").alias("file_id"), "entity_id", F.concat_ws("_", "entity_slug", "k").alias("filename"), F.lit("INR").alias("detected_unit"), F.lit("LIVE").alias("state"))
    found = reconcile.detect_conflicts(staging, files)
    return staging, files, found.join(reconcile.resolve(found, "open"), reconcile.KEY)


@query(""", o AS (SELECT entity_id, count(*) AS n FROM (SELECT entity_id FROM staging GROUP BY entity_id, canonical_field, period HAVING count(DISTINCT value_normalised) > 1) GROUP BY entity_id),
f AS (SELECT entity_id, file_id AS k, count(*) AS facts, count(DISTINCT canonical_field) AS metrics, count(DISTINCT period) AS periods FROM staging GROUP BY ALL)
SELECT CAST(s.entity_id * 10 + k.k AS INTEGER) AS file_id, s.entity_slug || '_' || CAST(k.k AS VARCHAR) AS filename, coalesce(facts, 0) AS facts, coalesce(metrics, 0) AS metrics, coalesce(periods, 0) AS periods, coalesce(o.n, 0) AS open_conflicts
FROM slugs s CROSS JOIN (VALUES (1), (2)) k(k) LEFT JOIN f ON f.entity_id = s.entity_id AND f.k = k.k LEFT JOIN o ON o.entity_id = s.entity_id""", with_facts=True)
def onboarding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.counts(*_filed(spark, sf_dir)).select("file_id", "filename", "facts", "metrics", "periods", "open_conflicts")


@query("SELECT entity_id, canonical_field, period, CAST(value_normalised AS DOUBLE) AS value FROM staging ORDER BY canonical_field, period, staging_id LIMIT 10", with_facts=True)
def onboarding_sample_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.sample(facts.staging(spark, sf_dir)).select("entity_id", "canonical_field", "period", number("value_normalised").alias("value"))


# ---- tools over whole tables (TOOL1-7, AGG2, AGG5, JON2, JON5, FLT4)


@query("SELECT fact_id, CAST(value_normalised AS DOUBLE) AS value, currency, filename FROM live JOIN files USING (file_id) WHERE canonical_field = 'revenue_net' AND period = 'FY97'", with_facts=True)
def fetch_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = tools.facts_of(facts.live(spark, sf_dir), "revenue_net", ["FY97"])
    return tools.sources(live, facts.files(spark)).select("fact_id", number("value_normalised").alias("value"), "currency", "filename")


@query(""", v AS (SELECT *, lag(value_normalised) OVER w AS last, lag(fiscal_year) OVER w AS last_year FROM live WINDOW w AS (PARTITION BY entity_id, canonical_field ORDER BY fiscal_year))
SELECT entity_id, canonical_field, period, CAST(value_normalised - last AS DOUBLE) AS delta, round(CAST(value_normalised - last AS DOUBLE) * 100 / CAST(last AS DOUBLE), 4) AS delta_pct FROM v WHERE last_year = fiscal_year - 1 AND last <> 0""", with_facts=True)
def variance_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tools.variances(facts.live(spark, sf_dir)).where("value_1 <> 0")
    return rows.select("entity_id", "canonical_field", "period", number("delta").alias("delta"), number("delta_pct").alias("delta_pct"))


@query("SELECT a.entity_id, a.period, round(CAST(a.value_normalised AS DOUBLE) / CAST(b.value_normalised AS DOUBLE), 4) AS ratio FROM live a JOIN live b USING (entity_id, period) WHERE a.canonical_field = 'cogs' AND b.canonical_field = 'revenue_net' AND b.value_normalised <> 0", with_facts=True)
def ratio_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.ratios(facts.live(spark, sf_dir), "cogs", "revenue_net").select("entity_id", "period", number("ratio").alias("ratio"))


@query("SELECT fact_id, file_id, filename FROM live JOIN files USING (file_id)", with_facts=True)
def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.sources(facts.live(spark, sf_dir), facts.files(spark)).select("fact_id", "file_id", "filename")


@query("SELECT entity_id, canonical_field AS metric, count(*) AS observations FROM live GROUP BY entity_id, canonical_field", with_facts=True)
def available_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.available_metrics(facts.live(spark, sf_dir), "entity_id")


@query("SELECT DISTINCT canonical_field, period FROM live", with_facts=True)
def valid_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.live(spark, sf_dir).select("canonical_field", "period").distinct()


@query("SELECT entity_id, entity_name FROM slugs WHERE lower(entity_name) LIKE '%nation 1%' OR contains(entity_slug, 'nation_1')", with_facts=True)
def entity_like_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.find_entities(facts.slugs(spark, sf_dir), "Nation 1").select("entity_id", "entity_name")


@query("SELECT n_nationkey AS entity_id, count(s_suppkey) AS files, count(*) FILTER (s_acctbal > 0) AS live_files FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def entity_state_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with how many files they have, live ones apart; suppliers stand for files."""
    entities = facts.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("entity_id"))
    files = facts.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("entity_id"), F.when(F.col("s_acctbal") > 0, "LIVE").otherwise("UPLOADED").alias("state"))
    return gates.entity_overview(entities, files)


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (0, 3, 7, 1000000)")
def chunks_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.by_ids(facts.table(spark, sf_dir, "documents"), "doc_id", [0, 3, 7, 1_000_000]).select("doc_id", "n_chars")


@query("SELECT doc_id, lower(lang) = 'en' OR lower(source) = 'en' AS is_one, contains(lower(lang), 'e') OR contains(lower(source), 'e') AS has_part FROM documents")
def linked_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array("lang", "source")
    return facts.table(spark, sf_dir, "documents").select("doc_id", tools.linked(names, "EN").alias("is_one"), tools.linked(names, "E", part=True).alias("has_part"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def event_rates_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = landing.event_rates(facts.table(spark, sf_dir, "events"))
    return rates.select(F.col("window.start").cast(facts.table(spark, sf_dir, "events").schema["ts"].dataType).alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


# ---- texts (FN13-FN16, TXT1-6, SRT4, SRT5)

_NOTE_SQL = "text || ' Revenue of Rs. ' || CAST(doc_id % 90 + 10 AS VARCHAR) || ' lakh in FY' || lpad(CAST(doc_id % 5 + 20 AS VARCHAR), 2, '0') || ' rose by 12.5% or 3.2x to ' || CAST(1000000 + doc_id AS VARCHAR) || ' units'"


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sentence of figures at their end."""
    d = F.col("doc_id")
    note = F.concat(F.lit(" Revenue of Rs. "), (d % 90 + 10).cast("string"), F.lit(" lakh in FY"), F.lpad((d % 5 + 20).cast("string"), 2, "0"), F.lit(" rose by 12.5% or 3.2x to "), (d + 1000000).cast("string"), F.lit(" units"))
    return facts.table(spark, sf_dir, "documents").select("doc_id", F.concat("text", note).alias("text"))


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(t, '[0-9]+\\.?[0-9]*\\s*%')) AS INTEGER) AS percentages, CAST(len(regexp_extract_all(t, '(?i)FY\\s*[0-9]{{2,4}}')) AS INTEGER) AS years, regexp_matches(t, '(?i)Rs\\. [0-9]+ lakh') AS money FROM (SELECT doc_id, {_NOTE_SQL} AS t FROM documents)")
def numerical_claims_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    years = F.filter(fn.claim_values(t, "period"), lambda c: F.upper(c).startswith("FY"))
    return _noted(spark, sf_dir).select("doc_id", F.size(fn.claim_values(t, "percentage")).alias("percentages"), F.size(years).alias("years"), t.rlike(r"(?i)Rs\. \d+ lakh").alias("money"))


@query(f"SELECT doc_id, regexp_extract(t, 'Rs\\. [0-9]+ lakh', 0) AS money, 'FY' || lpad(CAST(doc_id % 5 + 20 AS VARCHAR), 2, '0') AS period FROM (SELECT doc_id, {_NOTE_SQL} AS t FROM documents)")
def claim_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    money = F.filter(fn.claim_values(t, "currency"), lambda c: c.rlike(r"^Rs\. \d+ lakh$"))
    years = F.filter(fn.claim_values(t, "period"), lambda c: F.upper(c).startswith("FY"))
    return _noted(spark, sf_dir).select("doc_id", F.element_at(money, 1).alias("money"), F.element_at(years, -1).alias("period"))


_KINDS = ("currency", "period", "percentage", "bare_large_number", "multiplier")
# Fixed values, stated apart from the code that is held against them: what counts as a claim of each kind, and what makes a text one with claims.
_CLAIM_SQL = {
    "currency": r"(?i)(?:Rs\.?\s*|INR\s*|\$\s*|USD\s*)?\d[\d,]*\.?\d*\s*(?:lakh|lakhs|crore|crores|million|billion|thousand|mn|bn|cr\.?)\b",
    "period": r"(?i)(?:FY\s*\d{2,4}|FY\s*\d{2,4}[-_]Q[1-4]|FY\s*\d{2,4}[-_]M\d{1,2}|CY\s*\d{4}|Q[1-4]\s*['’]?\d{2}|\d{1,2}[.-]\d{2}[.-]\d{2,4}|\d{1,2}[-\s](?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-\s]\d{2,4})",
    "percentage": r"\d+\.?\d*\s*%",
    "bare_large_number": r"\b\d{6,}\b",
    "multiplier": r"\d+\.?\d*\s*x\b",
}
_KIND_SQL = ", ".join("CAST(len(regexp_extract_all(t, '" + _CLAIM_SQL[kind].replace("'", "''") + f"')) AS INTEGER) AS {kind}" for kind in _KINDS)
_FLAG_SQL = " OR ".join("regexp_matches(t, '" + _CLAIM_SQL[kind].replace("'", "''") + "')" for kind in ("currency", "period", "percentage", "multiplier"))


@query(f"SELECT doc_id, {_KIND_SQL}, {_FLAG_SQL} AS claims FROM (SELECT doc_id, {_NOTE_SQL} AS t FROM documents)")
def claims_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs.with_claims(_noted(spark, sf_dir), text="text")
    count = lambda kind: F.size(F.filter("numerical_claims", lambda c: c["type"] == kind)).alias(kind)
    counts = [count(kind) for kind in _KINDS]
    return rows.select("doc_id", *counts, F.col("contains_numerical_claim").alias("claims"))


@query(""", d AS (SELECT doc_id, CAST(doc_id % 25 AS INTEGER) AS entity_id, 'FY' || lpad(CAST((95 + doc_id % 7) % 100 AS VARCHAR), 2, '0') AS p FROM documents)
SELECT doc_id, coalesce(string_agg(DISTINCT fact_id, ',' ORDER BY fact_id), '') AS facts, coalesce(max(CASE WHEN live.period = p THEN p END), '') AS periods, coalesce(max(CASE WHEN canonical_field = 'cogs' THEN 'cogs' END), '') AS metrics
FROM d LEFT JOIN live ON live.entity_id = d.entity_id AND (live.period = p OR canonical_field = 'cogs') GROUP BY doc_id""", with_facts=True)
def link_notes_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each document, which names a metric and a year of its entity's."""
    year = F.lpad(((F.col("doc_id") % 7 + 95) % 100).cast("string"), 2, "0")
    note = F.concat(F.lit("The COGS of FY"), year, F.lit(" rose by 12.5%."))
    rows = facts.table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 25).cast("int").alias("entity_id"), note.alias("raw_text"))
    linked = docs.link_to_facts(docs.with_claims(rows), facts.live(spark, sf_dir))
    return linked.select("doc_id", *[F.array_join(c, ",").alias(n) for c, n in (("linked_fact_ids", "facts"), ("linked_periods", "periods"), ("linked_metrics", "metrics"))])


@query("SELECT doc_id, CAST(len(string_split_regex(trim(text), '[ \\t\\n\\x0B\\f\\r]+')) AS INTEGER) AS n_words, CAST(len(regexp_extract_all(text, '[^.!?]*[.!?]+\\s*')) AS INTEGER) AS n_sentences FROM documents")
def word_and_sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return facts.table(spark, sf_dir, "documents").select("doc_id", fn.word_count(t).alias("n_words"), F.size(fn.sentences(t)).alias("n_sentences"))


@query("SELECT doc_id, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'anderen') AS INTEGER) + CAST(contains(lower(text), 'ing') AS INTEGER) AS score FROM documents WHERE contains(lower(text), 'the') OR contains(lower(text), 'anderen') OR contains(lower(text), 'ing') ORDER BY score DESC, doc_id LIMIT 8")
def keyword_search_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.table(spark, sf_dir, "documents").select("doc_id", "text").withColumnRenamed("doc_id", "chunk_id")
    return docs.keyword_search(rows, "the anderen of ing", text="text").select(F.col("chunk_id").alias("doc_id"), "score")


@query("SELECT label, vec_id, place, round(score, 5) AS score FROM (SELECT label, vec_id, score, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS place FROM (SELECT e.label, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)) WHERE place <= 8")
def vector_search_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = facts.table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id = 0").select("embedding").first()
    found = docs.vector_search(rows, list(asked[0]) if asked else [1.0], by="label", key="vec_id")
    return found.select("label", "vec_id", "place", F.round("score", 5).alias("score"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = docs.chunk_documents(_noted(spark, sf_dir), claims=True)
    return chunks.select("doc_id", "chunk_index", fn.word_count(F.col("raw_text")).alias("n_words"), "contains_numerical_claim", F.size("numerical_claims").alias("n_claims"))


@query()
def link_chunks_to_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = docs.chunk_documents(_noted(spark, sf_dir), claims=True).withColumn("entity_id", (F.col("doc_id") % 25).cast("int"))
    live = facts.live(spark, sf_dir)
    return docs.link_to_facts(chunks, live).select("doc_id", "chunk_index", F.array_join("linked_fact_ids", ",").alias("facts"), F.array_join("linked_periods", ",").alias("periods"))


# ---- the router (RTR2-6)

_SPOKEN_SQL = router.Names([m.name for m in METRICS]).pattern.replace("\\ ", " ").replace("'", "''")
_PERIOD_SQL = "(?i)" + "|".join(p for p, _ in periods.NOTATIONS).replace("'", "''")
# Fixed values, stated apart from the code that is held against them: words of a question that ask for a tool, in their order.
_INTENT_SQL = """WHEN contains(q, 'available metrics') OR contains(q, 'what metrics') OR contains(q, 'list metrics') THEN 'list_available_metrics'
 WHEN contains(q, 'source') OR contains(q, 'citation') OR contains(q, 'where did') OR contains(q, 'which file') THEN 'list_sources'
 WHEN contains(q, 'context') OR contains(q, 'why') OR contains(q, 'explain') OR contains(q, 'narrative') OR contains(q, 'qualitative') THEN 'search_context'
 WHEN contains(q, 'variance') OR contains(q, 'change') OR contains(q, 'growth') OR contains(q, 'delta') THEN 'calculate_variance'
 WHEN contains(q, 'ratio') OR contains(q, 'margin') OR contains(q, 'divided by') OR contains(q, '/') THEN 'calculate_ratio'"""


@query(f"SELECT conv_id, turn, CASE {_INTENT_SQL} WHEN regexp_matches(q, '{_SPOKEN_SQL}') AND regexp_matches(q, '{_PERIOD_SQL}') THEN 'fetch_metric' ELSE 'help' END AS intent FROM (SELECT conv_id, turn, lower(text || CASE (conv_id * 10 + turn) % 3 WHEN 0 THEN ' profit in fy97?' WHEN 1 THEN ' cogs?' ELSE '' END) AS q FROM conversations)")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each turn of a conversation would be taken to ask, every other one with a metric, or a metric and a year, at its end."""
    k = (F.col("conv_id") * 10 + F.col("turn")) % 3
    asked = F.concat("text", F.when(k == 0, " Profit in FY97?").when(k == 1, " COGS?").otherwise(""))
    rows = facts.table(spark, sf_dir, "conversations").select("conv_id", "turn", asked.alias("question"))
    return rows.select("conv_id", "turn", router.intent(F.col("question"), [m.name for m in METRICS]).alias("intent"))


from . import audit  # noqa: E402, F401  its queries register here
