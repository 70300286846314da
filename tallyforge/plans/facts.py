"""The fact model over the star schema: nations are entities, fiscal years of order dates are periods, two files are sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import fiscal_year, period_of
from ..functions.text import fact_id, slugify
from ..operators.store import VALUE

MONEY = "decimal(18,2)"
METRICS = ("revenue_gross", "returns_refunds", "revenue_net", "cogs")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def if_small(df: DataFrame, most_rows: int = 1_000_000) -> DataFrame:
    """A dimension to be broadcast only if it has at most so many rows; beyond that Spark shuffles."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def sums(spark: SparkSession, sf_dir: str, grain: str = "year") -> DataFrame:
    """Amounts by entity and period. Lines are summed by order first (one shuffle on the key of the large join), then by entity."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", F.col("l_extendedprice").cast(MONEY).alias("price"), F.col("l_quantity").cast(MONEY).alias("quantity")
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast(MONEY).alias("retail"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("entity_id"))
    by_order = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("l_orderkey").agg(
        F.sum("price").alias("gross"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("price")).otherwise(F.lit(0).cast(MONEY))).alias("returns"),
        F.sum(F.col("quantity") * F.col("retail") * F.lit(0.6).cast("decimal(2,1)")).alias("cogs"),
    )
    dated = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "o_orderkey", "entity_id", period_of(F.col("o_orderdate"), grain).alias("period"), fiscal_year(F.year("o_orderdate"), F.month("o_orderdate")).alias("fiscal_year")
    )
    whole = by_order.join(dated, by_order["l_orderkey"] == dated["o_orderkey"]).groupBy("entity_id", "period", "fiscal_year")
    return whole.agg(F.sum("gross").alias("gross"), F.sum("returns").alias("returns"), F.sum("cogs").alias("cogs"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("entity_id"), F.col("n_name").alias("entity_name"), slugify(F.col("n_name")).alias("entity_slug"))


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "lineitem.csv"), (2, "orders_audited.csv")], "file_id int, filename string")


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files: the second repeats gross revenue, and differs by 1000 for every third entity."""
    values = {"revenue_gross": F.col("gross"), "returns_refunds": F.col("returns"), "revenue_net": F.col("gross") - F.col("returns"), "cogs": F.col("cogs")}
    made = [(1, k + 1, m, values[m]) for k, m in enumerate(METRICS)]
    made.append((2, 1, "revenue_gross", F.col("gross") + F.when(F.col("entity_id") % 3 == 0, 1000).otherwise(0)))
    row = F.explode(F.array(*[F.struct(F.lit(f).alias("file_id"), F.lit(k).alias("nth"), F.lit(m).alias("canonical_field"), v.cast(VALUE).alias("value_normalised")) for f, k, m, v in made]))
    rows = sums(spark, sf_dir).select("entity_id", "period", "fiscal_year", row.alias("r")).select("entity_id", "period", "fiscal_year", "r.*")
    number = ((F.col("file_id") * 100 + F.col("nth")) * 100 + F.col("entity_id")) * 100 + F.col("fiscal_year") % 100
    return rows.withColumn("staging_id", number.cast("long")).withColumn("currency", F.lit("INR"))


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the first file as live facts."""
    rows = staging(spark, sf_dir).where("file_id = 1").join(F.broadcast(slugs(spark, sf_dir)), "entity_id")
    return rows.withColumn("fact_id", fact_id(F.col("entity_slug"), F.col("period"), F.col("canonical_field")))


#: The same in SQL: common table expressions staging, slugs, files and live.
SQL = """
WITH base AS (
  SELECT CAST(c_nationkey AS INTEGER) AS entity_id, year(o_orderdate) + CAST(month(o_orderdate) >= 4 AS INTEGER) AS fiscal_year,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag, CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(p_retailprice AS DECIMAL(18,2)) AS retail
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
sums AS (
  SELECT entity_id, fiscal_year, 'FY' || lpad(CAST(fiscal_year % 100 AS VARCHAR), 2, '0') AS period, sum(price) AS gross,
         sum(CASE WHEN l_returnflag = 'R' THEN price ELSE 0 END) AS returns, sum(quantity * retail * CAST(0.6 AS DECIMAL(2,1))) AS cogs
  FROM base GROUP BY entity_id, fiscal_year),
files AS (SELECT * FROM (VALUES (1, 'lineitem.csv'), (2, 'orders_audited.csv')) f(file_id, filename)),
rows_ AS (
  SELECT entity_id, fiscal_year, period, 1 AS file_id, 1 AS nth, 'revenue_gross' AS canonical_field, CAST(gross AS DECIMAL(28,6)) AS value_normalised FROM sums
  UNION ALL SELECT entity_id, fiscal_year, period, 1, 2, 'returns_refunds', CAST(returns AS DECIMAL(28,6)) FROM sums
  UNION ALL SELECT entity_id, fiscal_year, period, 1, 3, 'revenue_net', CAST(gross - returns AS DECIMAL(28,6)) FROM sums
  UNION ALL SELECT entity_id, fiscal_year, period, 1, 4, 'cogs', CAST(cogs AS DECIMAL(28,6)) FROM sums
  UNION ALL SELECT entity_id, fiscal_year, period, 2, 1, 'revenue_gross', CAST(gross + CASE WHEN entity_id % 3 = 0 THEN 1000 ELSE 0 END AS DECIMAL(28,6)) FROM sums),
staging AS (SELECT *, CAST(((file_id * 100 + nth) * 100 + entity_id) * 100 + fiscal_year % 100 AS BIGINT) AS staging_id, 'INR' AS currency FROM rows_),
slugs AS (SELECT CAST(n_nationkey AS INTEGER) AS entity_id, n_name AS entity_name, regexp_replace(lower(trim(n_name)), '[^a-z0-9]+', '_', 'g') AS entity_slug FROM nation),
live AS (SELECT s.*, entity_name, entity_slug, 'f_' || entity_slug || '_' || period || '_' || canonical_field AS fact_id FROM staging s JOIN slugs USING (entity_id) WHERE file_id = 1)
"""
