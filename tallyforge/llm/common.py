"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

#: A word, for every operator here that counts or splits words.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch when whole texts go to Python; a batch ends with the text that reaches either.
TEXT_BATCH, TEXT_BYTES = 512, 16 << 20

_local_dir: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once when rows carry whole texts. Holds for the session's later queries too, whose results it does not change."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BYTES)):
        now = spark.conf.get(key, None) or ""
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(fields: list[StructField], added: str) -> StructType:
    """A schema of existing fields, whatever their names, and added ones in DDL."""
    return StructType([StructField(f.name, f.dataType) for f in fields] + StructType.fromDDL(added).fields)


def map_arrow(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """mapInArrow for columns of any names: run gets them by their places."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def free_name(wanted: str, taken: list[str]) -> str:
    """The wanted column name, with as many underscores as keep it apart from the taken ones."""
    lower = {t.lower() for t in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def plain_columns(df: DataFrame) -> list[str]:
    """Columns that have a hash (maps and variants have none)."""
    return [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where none is set, a local one if driver and executors are one process, as in tests; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="tallyforge-"))
        import shutil

        atexit.register(shutil.rmtree, _local_dir[0], ignore_errors=True)
    return "file://" + _local_dir[0]


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def remove(df: DataFrame) -> None:
    """Delete what written() wrote, once nothing reads it any more."""
    spark, path = df.sparkSession, df._written_path
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def n_words(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """A side of a join, to be broadcast only if it has at most so many rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def looked_up(rows: DataFrame, key: str, table: DataFrame, n_rows: int, within: str) -> DataFrame:
    """rows joined with a table that has one row for each key, inner, without a hot key's rows meeting in one task.

    Keys of more than a fair share of the rows are dealt into parts by the column within, and the table's rows for them
    are repeated for each part. There are few such keys, whatever n_rows is.
    """
    fair = max(1000, n_rows // 100_000)
    hot = rows.groupBy(key).count().where(F.col("count") > fair).select(key, F.ceil(F.col("count") / fair).cast("int").alias("__parts")).collect()  # at most 100,000
    if not hot:
        return rows.join(table, key)
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, with_fields(rows.select(key).schema.fields, "__parts int")))
    dealt = rows.join(parts, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(within), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    repeated = table.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(repeated, [key, "__part"]).drop("__part")


#: Multiplier and modulus that spread() mixes with.
SPREAD = (1103515245, 2147483647)


def spread(number: Column, parts: int) -> Column:
    """A part for each number; numbers of a regular pattern (all divisible by parts, say) fall evenly on the parts too."""
    by, modulus = map(F.lit, SPREAD)
    return F.pmod(F.pmod(F.pmod(number, modulus) * by, modulus), F.lit(parts))


def ranked(df: DataFrame, keys: list[str], within: str, order: list[Column], n_rows: int, rank: str, beside: DataFrame | None = None) -> DataFrame:
    """Add rank: 1, 2, ... among the rows with equal keys, ordered by (part of within, order).

    keys hold no nulls; within is a long column. No task gets all rows of a key: the rows of a key are dealt into
    parts by within (see spread), parts grow with n_rows, the sizes of parts are summed up in a table of (keys, part), and only
    a part's rows meet in a window. beside: a table by keys to be joined on; it joins the table of parts, so that the
    rows are shuffled once.
    """
    parts = max(8, -(-n_rows // 1_000_000))
    part = f"{rank}_part"
    dealt = df.withColumn(part, spread(F.coalesce(F.col(within), F.lit(0)), parts))
    before = (
        dealt.groupBy(*keys, part)
        .agg(F.count("*").alias(f"{rank}_n"))
        .withColumn(
            f"{rank}_off",
            F.coalesce(F.sum(f"{rank}_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .drop(f"{rank}_n")
    )
    if beside is not None:
        before = before.join(beside, keys)
    return (
        dealt.join(before, [*keys, part])
        .withColumn(rank, F.col(f"{rank}_off") + F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)))
        .drop(part, f"{rank}_off")
    )
