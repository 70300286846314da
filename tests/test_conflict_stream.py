"""The stream of conflicts against the batch, in any order, with late facts and with figures that are forgotten."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.streaming.conflicts import conflicts, ranges

SCHEMA = "entity_id int, canonical_field string, period string, value_normalised decimal(28,6), staging_id long, seen_at timestamp"
START = datetime(2024, 1, 1)


def streamed(spark, folder, batches):
    """What the stream gives out for batches of rows, one after another, as (batch, row)."""
    source, out = str(folder / "in"), str(folder / "out")
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = conflicts(stream).writeStream.format("parquet").option("path", f"{out}").option("checkpointLocation", str(folder / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def last(rows):
    """The last row of each key: that with the most facts."""
    key = ["entity_id", "canonical_field", "period"]
    return {tuple(r[k] for k in key): tuple(r)[3:7] for r in rows.orderBy("facts").collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(e, m, "FY24", Decimal(r.choice([100, 100, 100.3, 101, 90, -5, 0])), e * 100 + k, START + timedelta(hours=r.randrange(40))) for e in range(12) for m in ("revenue_net", "headcount") for k in range(r.randint(1, 5))]
    rows = [(*x[:3], x[3].quantize(Decimal("0.000001")), *x[4:]) for x in rows] + [(99, "cogs", "FY24", None, 1, START)]
    r.shuffle(rows)
    got = last(streamed(spark, tmp_path, [rows[k::3] for k in range(3)]))
    want = {tuple(x)[:3]: tuple(x)[3:7] for x in ranges(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want and want


def test_late_facts_and_forgotten_figures(spark, tmp_path):
    row = lambda e, v, i, days: (e, "headcount", "FY24", Decimal(v), i, START + timedelta(days=days))
    batches = [
        [row(1, 10, 1, 0), row(2, 20, 1, 0)], [row(1, 11, 2, 1)],  # they disagree at once
        [row(3, 1, 1, 60)], [row(3, 1, 2, 61)],  # figures of the first days are forgotten by now
        [row(2, 21, 2, 2)],  # late: left out
        [row(1, 12, 3, 61)],  # the first fact of the figure that is remembered
    ]
    got = [tuple(x)[:1] + tuple(x)[3:] for x in streamed(spark, tmp_path, batches).orderBy("entity_id", "facts").collect()]
    assert got == [(1, Decimal(10), Decimal(11), 1, 2, 2)]
    assert ranges(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).collect() == []
