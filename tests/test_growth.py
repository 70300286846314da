"""Algebra of periods, growth, names of entities by parts, units that do not fit."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import calendar
from tallyforge.operators import growth, ingest
from tallyforge.operators.tools import Tools, UnitMismatch

FACT = "entity_id int, canonical_field string, period string, value_normalised decimal(28,6)"


def test_periods_are_intervals(spark):
    want = {
        "FY24": (2023 * 12 + 3, 12, "FY12"), "FY70": (1969 * 12 + 3, 12, "FY12"), "FY69": (2068 * 12 + 3, 12, "FY12"), "FY00": (1999 * 12 + 3, 12, "FY12"), "FY24-Q1": (2023 * 12 + 3, 3, "FY3"),
        "FY24-Q4": (2024 * 12, 3, "FY3"), "FY24-M01": (2023 * 12 + 3, 1, "FY1"), "FY24-M12": (2024 * 12 + 2, 1, "FY1"), "CY2023": (2023 * 12, 12, "CY12"),
        "FY24-Q5": (None, None, None), "FY24-M13": (None, None, None), "FY2": (None, None, None), "": (None, None, None), None: (None, None, None), "Q1": (None, None, None),
    }
    p = F.col("p")
    got = spark.createDataFrame([(k,) for k in want], "p string").select("p", calendar.first_month(p), calendar.months(p), calendar.calendar(p)).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want
    pairs = {("FY24", "FY24-Q4"): (True, None), ("FY24", "FY23-Q4"): (False, None), ("FY24", "CY2023"): (False, None), ("FY22", "FY24"): (False, 2), ("FY24-Q1", "FY23-Q3"): (False, -2), ("FY99", "FY02"): (False, 3), ("FY24-Q2", "FY24-M05"): (True, None), ("FY24", "FY24"): (True, 0)}
    a, b = F.col("a"), F.col("b")
    got = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", calendar.contains(a, b), calendar.distance(a, b)).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == pairs


def test_growth_and_its_reasons(spark):
    values = {"FY98": 50, "FY99": 100, "FY00": 150, "FY02": 10, "FY03": 0, "FY04": 5, "FY05": -5, "FY06": 7, "FY07": 700, "FY04-Q1": 4, "FY05-Q1": 6, "CY2004": 1, "what": 3}
    live = spark.createDataFrame([(1, "m", p, Decimal(v)) for p, v in values.items()], FACT)
    got = {r["period"]: (r["growth_pct"] and float(r["growth_pct"]), r["reason"], r["sane"]) for r in growth.year_on_year(live).collect()}
    none = (None, "no_base", None)
    assert got == {
        "FY98": none, "FY99": (100.0, None, True), "FY00": (50.0, None, True), "FY02": none, "FY03": (-100.0, None, False), "FY04": (None, "zero_base", None), "FY05": (-200.0, None, False),
        "FY06": (None, "negative_base", None), "FY07": (9900.0, None, False), "FY04-Q1": none, "FY05-Q1": (50.0, None, True), "CY2004": none,
    }
    rates = {r["from_period"]: (r["from_period"], r["to_period"], float(r["years"]), r["cagr_pct"], r["reason"]) for r in growth.compound(live).collect()}
    assert rates["FY98"] == ("FY98", "FY07", 9.0, pytest.approx(((700 / 50) ** (1 / 9) - 1) * 100, abs=1e-4), None)
    assert rates["FY04-Q1"] == ("FY04-Q1", "FY05-Q1", 1.0, 50.0, None) and rates["CY2004"][3:] == (None, "one_period")
    units = live.where("period IN ('FY99', 'FY00')").withColumn("currency", F.when(F.col("period") == "FY99", "USD").otherwise("INR"))
    assert {r["period"]: r["reason"] for r in growth.year_on_year(units).collect()} == {"FY99": "no_base", "FY00": "unit"} and growth.compound(units).first()["reason"] == "unit"
    assert growth.year_on_year(live.limit(0)).collect() == [] == growth.compound(live.limit(0)).collect() and growth.parts(live.limit(0)).collect() == []


def test_parts_of_a_year(spark):
    rows = [("FY24", 100), *[(f"FY24-Q{q}", 25) for q in (1, 2, 3, 4)], ("FY25", 100), *[(f"FY25-M{m:02d}", 9) for m in range(1, 13)], ("FY26", 10), ("FY26-Q1", 3), ("FY27-Q1", 1)]
    got = {(r["period"], r["grain"]): (r["n"], float(r["total"]), r["agrees"]) for r in growth.parts(spark.createDataFrame([(1, "m", p, Decimal(v)) for p, v in rows], FACT)).collect()}
    assert got == {("FY24", "quarters"): (4, 100.0, True), ("FY25", "months"): (12, 108.0, False), ("FY26", "quarters"): (1, 3.0, None)}


def squeezed(s):
    return "".join(c for c in s.lower() if c.isascii() and c.isalnum())


def slug(s):
    import re

    return re.sub("[^a-z0-9]+", "_", s.strip().lower())


def test_names_of_entities_equal_brute_force(spark):
    r = random.Random(2)
    words = ["acme", "foods", "co", "x", "green", "harbor", "textiles", "of", "a"]
    pick = lambda n: r.choice([" ", "-", "  & "]).join(r.choice(words) for _ in range(r.randint(1, n)))
    known = [(i, n, slug(n)) for i, n in enumerate(dict.fromkeys(pick(3) for _ in range(60)))]
    names = [(i, pick(5) + r.choice(["", "s", " Report"])) for i in range(200)] + [(900, None), (901, ""), (902, "AC-ME")]
    entities = spark.createDataFrame(known, "entity_id int, entity_name string, entity_slug string")
    files = spark.createDataFrame(names, "file_id int, entity_name string")
    want = {}
    for i, n in names:
        fits = [(k, name) for k, name, s in known if n is not None and (squeezed(name) == squeezed(n) or s in slug(n))]
        want[i] = min(fits)[1] if fits else n
    found = ingest.same_names(files, entities)
    assert dict(map(tuple, found.collect())) == want and dict(map(tuple, ingest.same_names(files, entities.limit(0)).collect())) == dict(names)


def test_many_names_meet_no_cartesian_product(spark):
    n = 100_000
    entities = spark.range(n).selectExpr("CAST(id AS int) AS entity_id", "concat('Company ', hex(id * 7919)) AS entity_name", "concat('company_', lower(hex(id * 7919))) AS entity_slug")
    files = spark.range(n).selectExpr("CAST(id AS int) AS file_id", "concat('The Company ', hex(id * 7919), ' report') AS entity_name")
    found = ingest.same_names(files, entities)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    some = {r["file_id"]: r["entity_name"] for r in found.where("file_id % 9973 = 0").collect()}
    assert len(some) == 11 and all(name.startswith("Company ") for name in some.values())


def test_units_that_do_not_fit(spark):
    rows = [(1, "revenue_net", "FY23", Decimal(5), "INR"), (1, "revenue_net", "FY24", Decimal(6), "USD"), (1, "ebitda", "FY24", Decimal(1), "USD"), (1, "ebitda", "FY23", Decimal(1), None)]
    live = spark.createDataFrame(rows, FACT + ", currency string").withColumn("fact_id", F.lit("f"))
    tools = Tools(live, spark.createDataFrame([], "file_id int"), spark.createDataFrame([(1, "a", "a")], "entity_id int, entity_name string, entity_slug string"))
    with pytest.raises(UnitMismatch):
        tools.calculate_variance(1, "revenue_net", "FY23", "FY24")
    assert tools.calculate_ratio(1, "ebitda", "revenue_net", "FY24")["ratio"].startswith("0.1666") and tools.calculate_variance(1, "ebitda", "FY23", "FY24")["delta"] in ("0", "0.0")
