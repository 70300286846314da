"""Queries that hold figures against each other: totals, sources, lineage. They register in the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import calendar
from ..operators import agreement, growth, lineage, prose, totals
from ..operators import derive as kpi
from ..operators.pipeline import Engine
from ..operators.store import conform, scratch, shared_dir
from ..streaming import conflicts
from . import facts
from .catalogue import _workbook_files, number, query

# ---- totals of sheets

#: Lines of orders in a task.
LINES = 100_000


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet for each order: a section for each return flag (heading, lines, total), then a grand total. Some totals are off: a section's by 100, a grand total by -50.

    Lines are dealt by order once; what is made of an order stays in its task.
    """
    lines = facts.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast(facts.MONEY).alias("price"))
    # a line becomes several cells, which are sorted more than once: few lines in a task keep that in memory
    lines = lines.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), lines.count() // LINES + 1), "l_orderkey")
    order = Window.partitionBy("l_orderkey")
    section = Window.partitionBy("l_orderkey", "l_returnflag")
    nth = lambda by: F.row_number().over(by)
    lines = lines.withColumn("in_order", nth(order.orderBy("l_returnflag", "l_linenumber"))).withColumn("in_section", nth(section.orderBy("l_linenumber")))
    lines = lines.withColumn("total", F.sum("price").over(section)).withColumn("grand", F.sum("price").over(order))
    wrong = F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_returnflag") != "N"), 100).otherwise(0)
    row = lambda part, kind, label, raw: F.struct((F.col(part) if part else F.lit("~")).alias("section"), F.lit(kind).alias("kind"), label.alias("label"), raw.cast("string").alias("raw"))
    of_section = [
        row("l_returnflag", 0, F.concat(F.lit("Lines "), "l_returnflag"), F.lit(None)),
        row("l_returnflag", 2, F.concat(F.lit("Total "), "l_returnflag"), F.col("total") + wrong),
    ]
    of_order = row(None, 3, F.lit("Grand total"), F.col("grand") - F.when(F.col("l_orderkey") % 11 == 0, 50).otherwise(0))
    line = row("l_returnflag", 1, F.concat(F.lit("line "), "l_linenumber"), F.col("price"))
    made = F.array_compact(F.array(line, *[F.when(F.col("in_section") == 1, r) for r in of_section], F.when(F.col("in_order") == 1, of_order)))
    rows = lines.select("l_orderkey", F.col("l_linenumber").alias("nth"), F.explode(made).alias("r")).select("l_orderkey", "nth", "r.*")
    rows = rows.select(F.col("l_orderkey").alias("file_id"), F.lit("S1").alias("sheet"), (nth(order.orderBy("section", "kind", "nth")) - 1).alias("row_idx"), F.array("label", "raw").alias("cells"))
    return rows.select("file_id", "sheet", "row_idx", F.posexplode("cells").alias("col_idx", "raw"))


@query("""
WITH s AS (
  SELECT l_orderkey AS file_id, l_returnflag AS flag, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_orderkey, l_returnflag),
p AS (SELECT *, coalesce(sum(n + 2) OVER (PARTITION BY file_id ORDER BY flag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM s),
g AS (SELECT file_id, sum(n) AS n, sum(total) AS total, count(*) AS k, sum(n + 2) AS bottom FROM s GROUP BY file_id)
SELECT file_id, CAST(top + n + 1 AS BIGINT) AS row_idx, 'Total ' || flag AS label, CASE WHEN file_id % 7 = 0 AND flag <> 'N' THEN 'differs' ELSE 'matches' END AS status,
       CASE WHEN file_id % 7 = 0 AND flag <> 'N' THEN -1 ELSE CAST(top + 1 AS BIGINT) END AS first_row, n AS n_lines, CAST(0 AS BIGINT) AS n_totals, CAST(CASE WHEN file_id % 7 = 0 AND flag <> 'N' THEN 100 ELSE 0 END AS DOUBLE) AS difference FROM p
UNION ALL
SELECT file_id, CAST(bottom AS BIGINT), 'Grand total', CASE WHEN file_id % 11 = 0 THEN 'differs' ELSE 'matches' END, CASE WHEN file_id % 11 = 0 THEN -1 ELSE 1 END, CAST(n AS BIGINT), CASE WHEN file_id % 11 = 0 THEN 0 ELSE k END, CAST(CASE WHEN file_id % 11 = 0 THEN -50 ELSE 0 END AS DOUBLE) FROM g""")
def total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section totals and grand totals of a sheet for each order, right and wrong ones, held against their lines."""
    found = totals.check(totals.marked(_invoices(spark, sf_dir), whole=True), whole=True)
    return found.select("file_id", F.col("row_idx").cast("long").alias("row_idx"), "label", "status", F.coalesce("first_row", F.lit(-1)).cast("long").alias("first_row"), "n_lines", "n_totals", number("difference").alias("difference"))


# ---- agreement of sources


def _three_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every figure as a tally, an audit and a ledger state it: the audit is off by 0.3 % or 2 %, the ledger by 8 %, each for every third entity or so."""
    made = facts.staging(spark, sf_dir).where("file_id = 1")
    v, e = F.col("value_normalised"), F.col("entity_id")
    audit = F.when(e % 3 == 1, v * F.lit(1.003).cast("decimal(6,4)")).when(e % 3 == 2, v * F.lit(1.02).cast("decimal(6,4)")).otherwise(v)
    ledger = F.when(e % 4 == 1, v * F.lit(1.08).cast("decimal(6,4)")).otherwise(v)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.cast("decimal(28,6)").alias("v")) for k, x in ((1, v), (2, audit), (3, ledger))])).alias("s")
    rows = made.select("entity_id", "canonical_field", "period", (F.col("staging_id") * 10).alias("first"), kinds)
    rows = rows.select("entity_id", "canonical_field", "period", F.col("s.k").alias("file_id"), (F.col("first") + F.col("s.k")).alias("staging_id"), F.col("s.v").alias("value_normalised"))
    return rows, spark.createDataFrame([(1, "tally_export.csv"), (2, "accounts-audited.csv"), (3, "customer ledger.csv")], "file_id int, filename string")


@query(
    """, v AS (SELECT entity_id, canonical_field, period, staging_id * 10 AS first, value_normalised AS t,
  CAST(CASE entity_id % 3 WHEN 1 THEN value_normalised * CAST(1.003 AS DECIMAL(6,4)) WHEN 2 THEN value_normalised * CAST(1.02 AS DECIMAL(6,4)) ELSE value_normalised END AS DECIMAL(28,6)) AS a,
  CAST(CASE WHEN entity_id % 4 = 1 THEN value_normalised * CAST(1.08 AS DECIMAL(6,4)) ELSE value_normalised END AS DECIMAL(28,6)) AS l, CASE WHEN canonical_field = 'cogs' THEN 0.01 ELSE 0.005 END AS band FROM live WHERE value_normalised <> 0),
n AS (SELECT *, (a - t)::DOUBLE <= band * a::DOUBLE AS ta, l = t OR (l - a)::DOUBLE <= band * l::DOUBLE AS la FROM v)
SELECT entity_id, canonical_field, period, CAST(a AS DOUBLE) AS value, CAST(first + 2 AS BIGINT) AS staging_id, CASE WHEN ta THEN 1 ELSE 2 END + CASE WHEN l = t OR (l - a)::DOUBLE <= band * l::DOUBLE THEN 0 ELSE 1 END AS n_classes,
  CASE WHEN ta AND (l = t OR (l - a)::DOUBLE <= band * l::DOUBLE) THEN 3 WHEN ta THEN 2 WHEN l = t THEN 1 WHEN (l - a)::DOUBLE <= band * l::DOUBLE THEN 2 ELSE 1 END AS n_agree FROM n""",
    with_facts=True,
)
def agreement_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three sources state of every figure: the chosen value, how many classes of values there are, and how many sources agree with it."""
    rows, files = _three_sources(spark, sf_dir)
    found = agreement.classes(rows.where("value_normalised <> 0"), files)
    key = ["entity_id", "canonical_field", "period"]
    best = F.max_by(F.struct("value_normalised", "staging_id"), F.col("chosen").cast("int")).alias("c")
    out = found.groupBy(*key).agg(best, F.max("n_classes").alias("n_classes"), F.count_if(F.col("class") == 1).alias("n_agree"))
    return out.select(*key, number("c.value_normalised").alias("value"), "c.staging_id", F.col("n_classes").cast("int").alias("n_classes"), F.col("n_agree").cast("int").alias("n_agree"))


# ---- lineage


@query(
    """, n AS (SELECT entity_slug, period, bool_or(canonical_field = 'revenue_net' AND value_normalised <> 0) AS net FROM live GROUP BY ALL),
l AS (SELECT fact_id, fact_id AS leaf_id, 0 AS depth FROM live
  UNION ALL SELECT 'f_' || entity_slug || '_' || period || '_' || m, 'f_' || entity_slug || '_' || period || '_' || o, d FROM n, (VALUES ('gross_profit', 'revenue_net', 1), ('gross_profit', 'cogs', 1), ('gross_margin_pct', 'revenue_net', 1), ('gross_margin_pct', 'cogs', 2)) x(m, o, d) WHERE net OR m = 'gross_profit')
SELECT l.fact_id, leaf_id, depth, filename AS source_file, original_value, CASE WHEN depth = 0 THEN 'f' ELSE 'd' END AS kind FROM l JOIN (SELECT fact_id AS leaf, filename, CAST(value_normalised AS DOUBLE) AS original_value FROM live JOIN files USING (file_id)) v ON v.leaf = leaf_id""",
    with_facts=True,
)
def provenance_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells behind every fact, reported and derived, with the file and the value that each citation states."""
    rows = scratch(facts.live(spark, sf_dir), "live")
    reported = rows.select("fact_id", "entity_id", "entity_slug", "canonical_field", "period", "value_normalised", "currency", "staging_id", F.col("file_id").alias("source_file_id"), F.lit("S1").alias("source_sheet"), F.lit("B2").alias("cell_reference"))
    made = kpi.derive(reported)
    both = conform(reported.withColumn("is_derived", F.lit(False)), "live_facts").unionByName(conform(made, "live_facts"))
    staged = rows.select("staging_id", F.col("canonical_field").alias("row_context"), F.col("canonical_field").alias("raw_header"), number("value_normalised").alias("raw_value"))
    found = lineage.envelopes(both, staged, facts.files(spark))
    return found.select("fact_id", "leaf_id", "depth", "source_file", "original_value", F.when(F.col("depth") == 0, "f").otherwise("d").alias("kind"))


# ---- figures in prose


@query(
    """, y AS (SELECT entity_id, period, fiscal_year, round(gross / 10000000, 2) AS cr, round(returns / 100000, 1) AS lk, round(cogs) AS c, CASE WHEN gross = 0 THEN 0 ELSE round(CAST(returns AS DOUBLE) * 100 / CAST(gross AS DOUBLE), 1) END AS pct FROM sums),
t AS (SELECT *, printf('%.2f', cr) AS s1, printf('%.1f', lk) AS s2, format('{:,.0f}', c::DOUBLE) AS s3, printf('%.1f', pct) AS s4 FROM y),
u AS (SELECT *, 'In ' || period || ', gross revenue rose to approx. Rs. ' AS a, ' crore, while refunds were over ' AS b, ' lakh; ' AS c1, 'COGS fell by ' AS d, '% to $' AS e FROM t)
SELECT entity_id, period, 'revenue_gross' AS metric, 'value' AS kind, 'about' AS hedge, 'INR' AS currency, CAST(s1 AS DOUBLE) * 1e7 AS value, length(a) - 12 AS start, length(a) + length(s1) + 6 AS stop FROM u
UNION ALL SELECT entity_id, period, 'returns_refunds', 'value', 'at least', 'INR', CAST(s2 AS DOUBLE) * 1e5, length(a || s1 || b) - 5, length(a || s1 || b || s2) + 5 FROM u
UNION ALL SELECT entity_id, period, 'cogs', 'change', NULL, 'PERCENTAGE', 0 - CAST(s4 AS DOUBLE), length(a || s1 || b || s2 || c1 || d), length(a || s1 || b || s2 || c1 || d || s4) + 1 FROM u
UNION ALL SELECT entity_id, period, 'cogs', 'value', NULL, 'USD', CAST(c AS DOUBLE), length(a || s1 || b || s2 || c1 || d || s4 || e) - 1, length(a || s1 || b || s2 || c1 || d || s4 || e || s3) FROM u""",
    with_facts=True,
)
def prose_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences on every nation's year, and the figures read from them: hedged, scaled, changed, with the period of the sentence or of the one before."""
    sums = facts.sums(spark, sf_dir)
    gross, returns, cogs = (F.col(c) for c in ("gross", "returns", "cogs"))
    shown = lambda c, places: F.regexp_replace(F.format_number(F.round(c, places), places), ",", "")
    share = F.when(gross == 0, 0.0).otherwise(F.round(returns.cast("double") * 100 / gross.cast("double"), 1))
    said = F.concat(
        F.lit("In "), "period", F.lit(", gross revenue rose to approx. Rs. "), shown(gross / 10000000, 2), F.lit(" crore, while refunds were over "), shown(returns / 100000, 1),
        F.lit(" lakh; COGS fell by "), shown(share, 1), F.lit("% to $"), F.format_number(F.round(cogs, 0), 0),
    )
    found = prose.extract(sums.select("entity_id", said.alias("raw_text")), keep=["entity_id"])
    return found.select("entity_id", "period", "metric", "kind", "hedge", "currency", number("value").alias("value"), "start", F.col("end").alias("stop"))


# ---- growth over periods


_QUARTERS = """
WITH b AS (
  SELECT CAST(c_nationkey AS INTEGER) AS entity_id, (year(o_orderdate) * 12 + month(o_orderdate) - 1 - 3) // 3 AS q, CAST(l_extendedprice AS DECIMAL(18,2)) AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
q AS (SELECT entity_id, q, sum(price) AS v, 'FY' || lpad(CAST((q // 4 + 1) % 100 AS VARCHAR), 2, '0') || '-Q' || CAST(q % 4 + 1 AS VARCHAR) AS period FROM b WHERE (q * 7 + entity_id) % 9 <> 0 GROUP BY ALL)
"""


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gross revenue of every nation by quarter, with gaps."""
    rows = facts.sums(spark, sf_dir, "quarter").select("entity_id", F.lit("revenue_gross").alias("canonical_field"), "period", F.col("gross").cast("decimal(28,6)").alias("value_normalised"))
    nth = F.floor((calendar.first_month(F.col("period")) - 3) / 3)
    return rows.where(F.pmod(nth * 7 + F.col("entity_id"), F.lit(9)) != 0)


@query(_QUARTERS + "SELECT a.entity_id, a.period, CAST(b.v AS DOUBLE) AS base, round((a.v - b.v)::DOUBLE * 100 / b.v::DOUBLE, 4) AS growth_pct, CASE WHEN b.v IS NULL THEN 'no_base' END AS reason FROM q a LEFT JOIN q b ON a.entity_id = b.entity_id AND b.q = a.q - 4")
def growth_year_on_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters against the same quarter a year before, where there is one."""
    found = growth.year_on_year(_quarters(spark, sf_dir))
    return found.select("entity_id", "period", number("base").alias("base"), number("growth_pct").alias("growth_pct"), "reason")


@query(_QUARTERS + "SELECT entity_id, arg_min(period, q) AS from_period, arg_max(period, q) AS to_period, (max(q) - min(q)) / 4.0::DOUBLE AS years, CASE WHEN max(q) > min(q) THEN round((pow(arg_max(v, q)::DOUBLE / arg_min(v, q)::DOUBLE, 4.0::DOUBLE / (max(q) - min(q))) - 1) * 100, 4) END AS cagr_pct, CASE WHEN max(q) = min(q) THEN 'one_period' END AS reason FROM q GROUP BY entity_id")
def growth_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The yearly rate from the first quarter to the last."""
    return growth.compound(_quarters(spark, sf_dir)).drop("canonical_field").withColumn("years", number("years"))


@query(_QUARTERS + ", y AS (SELECT entity_id, q // 4 AS y, sum(price) AS v FROM b GROUP BY ALL) SELECT q.entity_id, 'FY' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS period, count(*) AS n, CAST(any_value(y.v) AS DOUBLE) AS value, CAST(sum(q.v) AS DOUBLE) AS total, CASE WHEN count(*) = 4 THEN 'agrees' ELSE 'part' END AS verdict FROM q JOIN y ON q.entity_id = y.entity_id AND q.q // 4 = y GROUP BY q.entity_id, y")
def parts_of_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fiscal years held against the quarters that there are of them."""
    years = facts.sums(spark, sf_dir).select("entity_id", F.lit("revenue_gross").alias("canonical_field"), "period", F.col("gross").cast("decimal(28,6)").alias("value_normalised"))
    found = growth.parts(_quarters(spark, sf_dir).unionByName(years))
    return found.select("entity_id", "period", "n", number("value").alias("value"), number("total").alias("total"), F.when(F.col("agrees"), "agrees").when(~F.col("agrees"), "differs").otherwise("part").alias("verdict"))


# ---- loads


@query(
    """SELECT CASE WHEN entity_id >= 10 THEN 'NATION Holdings' ELSE 'NATION ' || CAST(entity_id AS VARCHAR) || ' Holdings' END AS entity_name, canonical_field, period,
  arg_min(CAST(round(value_normalised, 2) * 100000 AS DOUBLE), entity_id) AS value, 'LIVE' AS state, CAST(0 AS BIGINT) AS again
FROM live WHERE canonical_field <> 'revenue_net' GROUP BY 1, 2, 3""",
    with_facts=True,
)
def files_loaded_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each nation, loaded into a store, and loaded again: what is live then, and how many files the second load took.

    Names of nations from the tenth on are all alike without their numbers, so they are one entity; of its conflicts the file that was staged first decides.
    """
    files = _workbook_files(spark, sf_dir, ".xlsx")
    name = F.concat(F.lit("book"), F.col("file_id").cast("string"), F.lit(".xlsx"))
    files = scratch(files.select(F.concat(F.lit("/in/"), name).alias("path"), name.alias("filename"), "file_type", F.sha2("content", 256).alias("checksum"), "content"), "files")
    engine = Engine(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    engine.load(files)
    again = engine.load(files)["files"]
    live, names = engine.store.read("live_facts"), engine.store.read("entities").select("entity_id", "entity_name")
    states = engine.store.read("source_files").select(F.col("file_id").alias("source_file_id"), "state")
    rows = live.join(names, "entity_id").join(states, "source_file_id")
    return rows.select("entity_name", "canonical_field", "period", number("value_normalised").alias("value"), "state", F.lit(again).cast("long").alias("again"))


@query(
    """, x AS (SELECT entity_id, canonical_field, period, CAST(staging_id * 10 + k AS BIGINT) AS staging_id,
  CAST(value_normalised * CASE WHEN k = 2 AND entity_id % 3 = 1 THEN CAST(1.003 AS DECIMAL(6,4)) WHEN k = 2 AND entity_id % 3 = 2 THEN CAST(1.02 AS DECIMAL(6,4)) WHEN k = 3 AND entity_id % 4 = 1 THEN CAST(1.08 AS DECIMAL(6,4)) ELSE CAST(1 AS DECIMAL(6,4)) END AS DECIMAL(28,6)) AS v FROM live, (VALUES (1), (2), (3)) s(k)),
r AS (SELECT entity_id, canonical_field, period, min(v) AS low, max(v) AS high, arg_min(staging_id, (v, staging_id)) AS low_id, arg_min(staging_id, (-v, staging_id)) AS high_id, count(*) AS facts FROM x GROUP BY 1, 2, 3)
SELECT entity_id, canonical_field, period, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, low_id, high_id, facts FROM r WHERE (high - low)::DOUBLE > CASE WHEN canonical_field = 'cogs' THEN 0.01 ELSE 0.005 END * high::DOUBLE""",
    with_facts=True,
)
def conflict_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures whose sources differ by more than the metric's band, with the facts at both ends: what the stream of conflicts has named last."""
    found = conflicts.ranges(_three_sources(spark, sf_dir)[0])
    return found.withColumns({c: number(c) for c in ("low", "high")})
