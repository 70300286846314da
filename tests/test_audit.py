"""Agreement of sources, lineage and citations, figures in prose."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.names import Matcher, metric_names
from tallyforge.operators import agreement, lineage, prose
from tallyforge.operators.pipeline import Engine
from tallyforge.operators.prose import figures
from tallyforge.operators.tools import ToolError

KEY = "entity_id int, canonical_field string, period string"


def brute_classes(rows, ranks, band):
    """rows: (staging_id, value, file): class of each, number of classes, chosen staging_id."""
    values = sorted({v for _, v, _ in rows})
    groups = [[values[0]]]
    for a, b in zip(values, values[1:]):
        if float(b - a) > band * float(max(abs(a), abs(b))):
            groups.append([])
        groups[-1].append(b)
    of = lambda g: [r for r in rows if r[1] in g]
    groups.sort(key=lambda g: (min(ranks[f] for _, _, f in of(g)), -len(of(g)), g[0]))
    chosen = min(of(groups[0]), key=lambda r: (ranks[r[2]], r[0]))[0]
    return {s: (next(k for k, g in enumerate(groups, 1) if v in g), len(groups), s == chosen) for s, v, _ in rows}


def test_classes_equal_brute_force(spark):
    r = random.Random(1)
    names = ["x_tally.csv", "audited accounts.csv", "customer_ledger.xls", "owner-deck.docx", "unknown.csv", "tallyho.csv"]
    ranks = dict(enumerate([1, 0, 3, 2, 4, 4]))
    files = spark.createDataFrame(list(enumerate(names)), "file_id int, filename string")
    rows, want, n = [], {}, 0
    for key, (metric, share) in enumerate([("revenue_net", 0.005), ("ebitda", 0.01), ("headcount", 0), ("gross_margin_pct", 0), ("other", 0)] * 6):
        base, mine = r.choice([100, -100, 0, 1000]), []
        for _ in range(r.randint(1, 9)):
            mine.append((n, Decimal(base) * Decimal(r.choice(["1", "1", "1.003", "1.004", "1.008", "1.02", "0.9"])), r.randrange(6)))
            n += 1
        want |= brute_classes(mine, ranks, share)
        rows += [(key, metric, "FY24", s, v, f) for s, v, f in mine]
    rows.append((99, "cogs", "FY24", n, None, 0))
    staging = spark.createDataFrame(rows, KEY + ", staging_id long, value_normalised decimal(28,6), file_id int")
    got = {x["staging_id"]: (x["class"], x["n_classes"], x["chosen"]) for x in agreement.classes(staging, files).collect()}
    assert got == want and agreement.classes(staging.limit(0), files).collect() == []
    decided = {x["entity_id"]: x["state"] for x in agreement.decide(staging, files).collect()}
    distinct = {k for k, *_ in rows if len({x[4] for x in rows if x[0] == k}) > 1}
    assert set(decided) == distinct and all((s == "OPEN") == (got[next(x[3] for x in rows if x[0] == k)][1] > 1) for k, s in decided.items())


def test_lineage_of_formulas_upon_formulas(spark):
    row = lambda i, metric, made=None: (f"f_a_FY24_{i}", "a", "FY24", made is not None, made or [])
    rows = [row("x", "x"), row("y", "y"), row("s", "s", ["x", "y"]), row("t", "t", ["s", "y"]), row("u", "u", ["t", "missing"]), row("p", "p", ["q"]), row("q", "q", ["p", "x"])]
    live = spark.createDataFrame(rows, "fact_id string, entity_slug string, period string, is_derived boolean, derived_from array<string>")
    got = {(r["fact_id"][-1], r["leaf_id"][-1]): r["depth"] for r in lineage.closure(live).collect()}
    assert got == {("x", "x"): 0, ("y", "y"): 0, ("s", "x"): 1, ("s", "y"): 1, ("t", "x"): 2, ("t", "y"): 1, ("u", "x"): 3, ("u", "y"): 2, ("p", "x"): 2, ("q", "x"): 1}
    assert lineage.closure(live.limit(0)).collect() == []


def test_sources_ranked_within_a_band_and_cited(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, revenue, cogs in (("acme_tally.csv", "100.4", "40"), ("acme_audited.csv", "100", "50")):
        (tmp_path / "in" / name).write_text(f"Metric (Rs. Lakhs),FY23,FY24\nRevenue,90,{revenue}\nCOGS,30,{cogs}\n")
    engine = Engine(spark, str(tmp_path / "store"), policy="ranked")
    engine.load_folder(str(tmp_path / "in"))
    states = {r["canonical_field"]: (r["state"], r["resolution_staging_id"]) for r in engine.store.read("conflicts").collect()}
    revenue = next(m for m in states if m.startswith("revenue"))
    assert {m: s for m, (s, _) in states.items()} == {revenue: "RESOLVED", "cogs": "OPEN"}
    live = {(r["canonical_field"], r["period"]): r for r in engine.store.read("live_facts").collect()}
    assert float(live["cogs", "FY24"]["value_normalised"]) == 5e6 and live["cogs", "FY24"]["authoritative_note"] == "sources disagree" and float(live[revenue, "FY24"]["value_normalised"]) == 1e7
    tools = engine.tools()
    cited = tools.cite("acme", "cogs", "FY24")["citations"]
    assert [(c["source_file"], c["cell"], c["row_label"], c["column_label"], c["original_value"], c["transformation"], c["confidence"], c["source_kind"], len(c["conflicts_with"])) for c in cited] == [
        ("acme_audited.csv", "C3", "COGS", "FY24", 50.0, "times 100000", "low", "audited", 1)
    ]
    if ("gross_profit", "FY23") in live:
        both = tools.cite("acme", "gross_profit", "FY23")["citations"]
        assert [(c["canonical_field"], c["depth"], c["confidence"]) for c in both] == [("cogs", 1, "medium" if "tally" in both[0]["source_file"] else "high"), (revenue, 1, both[1]["confidence"])]
    tools.staging = None
    with pytest.raises(ToolError):
        tools.cite("acme", "cogs", "FY24")


def test_names_are_whole_words_and_the_longest(spark):
    find = Matcher({"net revenue": "a", "revenue": "b", "arr": "c", "arr ($000s)": "d", "r&d": "e"}).find
    assert find("Net Revenue, revenue; arrears ARR ($000s) R&D") == [(0, 11, "a"), (13, 20, "b"), (30, 41, "d"), (42, 45, "e")]
    assert find("") == [] and find("İrevenue x_revenue") == [] and len(metric_names()) > 150


CASES = {
    "Revenue of FY24 rose by 12.5%.": [("revenue_net", "FY24", "change", None, Decimal("12.5"), None, 1)],
    "EBITDA margin stood at about 22% in Q1 FY24 and headcount was 1,200.": [("ebitda_margin_pct", "Q1 FY24", "percent", "about", Decimal(22), None, 1), ("headcount", "Q1 FY24", "value", None, Decimal(1200), None, 1)],
    "In 2023 PAT was -3.2 million USD": [("pat", "2023", "value", None, Decimal("-3.2"), "USD", 1_000_000)],
    "FY22 was hard. COGS fell 4 per cent, while inventory was under Rs.5 cr. of stock": [("cogs", "FY22", "change", None, Decimal(-4), None, 1), ("inventory", "FY22", "value", "at most", Decimal(5), "INR", 10_000_000)],
    "approx 22% gross margin": [("gross_margin_pct", None, "percent", "about", Decimal(22), None, 1)],
    "no metric 5 crore here, 17 there": [],
    "profit after tax 3rd, v2.1, 12345678901234567890123 of revenue": [],
    "": [],
}


@pytest.mark.parametrize("text", CASES)
def test_figures(text):
    assert [(f[8], f[9], f[5], f[3], f[4], f[6], f[7]) for f in figures(text)] == CASES[text]
    assert all(text[f[0] : f[1]] == f[2] for f in figures(text))


def test_figures_of_odd_texts_and_as_facts(spark):
    rows = [(1, 7, 3, "Net revenue was over Rs. 5 crore in FY24 and COGS fell by 3%."), (1, 8, 3, None), (1, 9, 3, ""), (1, 7, 3, "Net revenue was over Rs. 5 crore in FY24 and COGS fell by 3%."), (2, 1, 1, "word " * 50_000 + "headcount 12 in FY23")]
    df = spark.createDataFrame(rows, "entity_id int, chunk_id long, file_id int, raw_text string").withColumn("a.b", F.lit(1)).withColumn("n", F.lit(2))
    out = prose.extract(df, keep=["entity_id", "chunk_id", "file_id", "a.b"])
    assert out.columns[:4] == ["entity_id", "chunk_id", "file_id", "a.b"] and out.count() == 5 and prose.extract(df.limit(0)).count() == 0
    made = prose.as_facts(out, spark.createDataFrame([(1, "acme"), (2, "b")], "entity_id int, entity_slug string")).collect()
    assert sorted((r.fact_id, float(r.value_normalised), r.currency, r.original_unit, r.conversion_factor, r.hedge) for r in made) == [
        ("f_acme_FY24_revenue_net", 5e7, "INR", "INR Crore", 1e7, "at least")] * 2 + [("f_b_FY23_headcount", 12.0, None, "", 1.0, None)]
