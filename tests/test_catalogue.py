"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from tallyforge.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def shown(rows):
    one = lambda v: "" if v is None or v != v else f"{float(v):.10g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted("|".join(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    rows = got.collect()
    if name not in ORACLES:
        assert rows
        return
    want = con.execute(ORACLES[name]).fetchdf()
    assert sorted(want.columns) == sorted(got.columns)
    assert shown(map(tuple, rows)) == shown(want[got.columns].astype(object).itertuples(index=False, name=None))


def test_balances_of_all_sizes_are_shown_as_in_sql(spark, tmp_path):
    odd = ["0", "-0.0", "-0.01", "-0.4", "-0.49999999999999994", "-0.5", "0.5", "1.5", "2.5", "-2.5", "-999.5", "1004.5", "9999.99", "1e10", "-1e15", "nan", "inf", "-inf", None]
    rows = ", ".join(f"({3 * k + i}, {'NULL' if v is None else repr(v)})" for k, v in enumerate(odd) for i in range(3))
    duckdb.sql(f"COPY (SELECT CAST(k AS BIGINT) AS s_suppkey, CAST(v AS DOUBLE) AS s_acctbal FROM (VALUES {rows}) x(k, v)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    want = duckdb.connect().execute(ORACLES["display_format"].replace("FROM supplier", f"FROM '{tmp_path}/supplier.parquet'")).fetchall()
    got = [tuple(r) for r in QUERIES["display_format"](spark, str(tmp_path)).collect()]
    assert len(got) == 3 * len(odd) and sorted(got) == sorted(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
