"""From sheets and documents to answers: extraction, reconciliation, validation, tools, router, store, stream."""

import io
import json
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import tallyforge.__main__ as main
from tallyforge.functions.aliases import clear_aliases, resolve_headers
from tallyforge.operators import derive, gates, ingest, mapper, reconcile, text, validate
from tallyforge.operators.pipeline import Engine
from tallyforge.operators.router import Router, check_plan, find_metric, parse_plan, planner_request, ratio_parts, remote_planner, response_text
from tallyforge.operators.store import SCHEMAS, Store, conform, move, schema
from tallyforge.operators.tools import AmbiguousEntity, DivisionByZero, EntityNotFound, MetricNotFound, PeriodNotFound, Tools, _exact
from tallyforge.sources import biff, documents, samples, sheets

MONTHS = ["Apr-23", "May-23", "Jun-23", "Jul-23", "Aug-23", "Sep-23", "Oct-23", "Nov-23", "Dec-23", "Jan-24", "Feb-24", "Mar-24"]
MONTHLY = ["GMV", "Net Revenue", "COGS", "Salary", "Marketing", "Rent", "Opex", "EBITDA", "Net Profit", "Headcount", "Orders"]
AUDITED = {"Revenue from operations": [21.7, 25.9, 31.6], "COGS": [13.2, 15.8, 19.1], "Opex": [2.3, 2.6, 3.4], "EBITDA": [4.4, 5.6, 6.7], "PAT": [2.8, 3.5, 4.6], "Trade receivables": [3.3, 4.1, 4.9], "Inventory": [2.2, 2.7, 3.3], "Cash": [1.2, 1.4, 1.7], "Total debt": [5.6, 5.1, 4.2], "Trade payables": [1.6, 1.9, 2.3], "Salary": [1.1, 1.3, 1.5]}
MANAGED = {"Turnover": [21.7, 25.9, 32.4], "COGS": [13.2, 15.8, 19.7], "EBITDA": [4.4, 5.6, 6.4], "PAT": [2.8, 3.5, 4.5], "Debtors": [3.3, 4.1, 5.2], "Inventory": [2.2, 2.7, 3.6], "Opex": [2.3, 2.6, 3.4], "Cash": [1.2, 1.4, 1.7]}


def sheet(first, columns, rows, above=()):
    lines = [*above, ",".join([first, *columns])] + [",".join([k, *map(str, v)]) for k, v in rows.items()]
    return "\n".join(lines).encode()


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    monthly = {m: [12 if m == "Headcount" else round(10 + i + k / 10, 2) for k in range(12)] for i, m in enumerate(MONTHLY)}
    (d / "meadow_foods_mis.csv").write_bytes(sheet("Metric (Rs. Lakhs)", MONTHS, monthly))
    (d / "harbor_engineering_audited.csv").write_bytes(sheet("Particulars (INR Crore)", ["FY22", "FY23", "FY24"], AUDITED))
    (d / "harbor_engineering_management.csv").write_bytes(sheet("Revenue Summary (Rs. Crore)", ["FY22", "FY23", "FY24"], MANAGED))
    (d / "notes.txt").write_text("ignored")
    return d


@pytest.fixture(scope="module")
def engine(spark, corpus, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), policy="prefer", prefer="audited")
    e.result = e.load_folder(str(corpus))
    return e


def test_corpus_goes_live(spark, engine):
    assert engine.result["files"] == 3 and engine.result["staged"] == 132 + 33 + 24 and engine.result["conflicts"] == 6 and not engine.result["errors"]
    staged = engine.store.read("staging_facts")
    assert {r.value_normalised for r in staged.where("canonical_field = 'headcount'").collect()} == {Decimal("12.000000")}
    assert staged.where("canonical_field = 'gmv' AND period = 'FY24-M01'").first().value_normalised == Decimal("1000000.000000")
    assert sorted(r.entity_slug for r in engine.store.read("entities").collect()) == ["harbor_engineering", "meadow_foods"]
    live = engine.store.read("live_facts")
    key = live.groupBy("entity_id", "canonical_field", "period").count().where("count > 1").count()
    assert key == 0 and engine.result["live"] == 180 + 45 == live.count()
    r = live.where("entity_slug = 'harbor_engineering' AND canonical_field = 'revenue_net' AND period = 'FY24'").first()
    assert r.value_normalised == Decimal("316000000.000000") and r.authoritative_note and r.cell_reference == "D2"
    assert {r.state for r in engine.store.read("source_files").collect()} == {"LIVE"} and engine.store.read("ingestion_log").count() == 3


def test_loading_again_changes_nothing(spark, engine, corpus):
    before = engine.store.read("staging_facts").count()
    assert engine.load_folder(str(corpus))["files"] == 0 and engine.store.read("staging_facts").count() == before


def test_compat_reads_quirks(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path), compat=True, policy="prefer", prefer="audited")
    e.load_folder(str(corpus))
    staged = e.store.read("staging_facts")
    assert staged.where("canonical_field = 'headcount'").first().value_normalised == Decimal("1200000.000000")
    pair = staged.join(e.store.read("source_files").select("file_id", "filename"), "file_id").where("filename like 'harbor%'")
    assert pair.count() == 57 and {r.period for r in pair.collect()} == {"FY24"}


def test_gate_refuses(spark, corpus, tmp_path):
    seen = []
    e = Engine(spark, str(tmp_path), gate=lambda t: seen.append(t) or False)
    assert e.load_folder(str(corpus))["live"] == 0 and "open conflicts" in seen[0]
    assert e.store.read("live_facts").count() == 0 and {r.state for r in e.store.read("source_files").collect()} == {"AWAITING_ACKNOWLEDGMENT"}


def test_gate_policies():
    for said, want in (("", True), ("y", True), ("n", False), ("No", False), ("what", True)):
        assert gates.ask(lambda _, s=said: s)("?") is want

    def end(_):
        raise EOFError

    def stop(_):
        raise KeyboardInterrupt

    assert gates.ask(end)("?") is True and gates.ask(stop)("?") is False


# ---- sheets


def grid_of(spark, content, kind=".csv"):
    files = spark.createDataFrame([(1, kind, bytearray(content))], "file_id int, file_type string, content binary")
    return sheets.read_grid(files)


def facts_of(spark, content, compat=False, kind=".csv"):
    grid = grid_of(spark, content, kind)
    about = ingest.discover(grid)
    return ingest.extract(ingest.cells(grid, about), about.select("file_id", "sheet", "unit"), compat=compat)


def test_header_is_found_below_a_preamble(spark):
    content = sheet("Metric", ["FY23", "FY24", "Notes"], {"Revenue (net)": ["1,5", 2, "x 9"], "TOTAL": [9, 9, ""], "--- section": ["", "", ""], "Rent (Rs absolute)": ["(8.20)", "67.0% (calc)", "none"]}, above=["Meadow Foods - Monthly P&L", "All figures in Rs. Lakhs"]).replace(b"1,5", b'"1,5"')
    grid = grid_of(spark, content)
    about = ingest.discover(grid).first()
    assert about.header_row == 2 and about.preamble == ["Meadow Foods - Monthly P&L", "All figures in Rs. Lakhs"] and about.unit == "All figures in Rs. Lakhs"
    got = {(r.canonical_field, r.period): (float(r.value_normalised), r.currency, r.cell_reference) for r in facts_of(spark, content).collect()}
    assert got == {("revenue_net", "FY23"): (1500000.0, "INR", "B4"), ("revenue_net", "FY24"): (200000.0, "INR", "C4"), ("rent_expense", "FY23"): (-8.2, "INR", "B7")}
    notes = ingest.annotations(ingest.cells(grid, ingest.discover(grid)))
    assert {r.raw_text: r.contains_numerical_claim for r in notes.collect()} == {"x 9": True, "none": False}
    names = ingest.entity_names(ingest.discover(grid), spark.createDataFrame([(1, "x_mis_fy24.csv")], "file_id int, filename string"))
    assert names.first().entity_name == "Meadow Foods"


def test_names_from_files(spark):
    none = spark.createDataFrame([], "file_id int, sheet string, preamble array<string>")
    files = spark.createDataFrame([(1, "acme_foods_pnl_2024.xlsx"), (2, "fy24.csv")], "file_id int, filename string")
    assert {r.file_id: r.entity_name for r in ingest.entity_names(none, files).collect()} == {1: "Acme Foods", 2: "Fy24"}


def test_tall_and_ledger(spark):
    tall = sheet("Period", ["Revenue", "COGS"], {"FY23": [1, 2], "FY24": [3, 4]})
    assert {(r.canonical_field, r.period, r.raw_value, r.layout) for r in facts_of(spark, tall).collect()} == {("revenue_net", "FY23", 1.0, "tall"), ("cogs", "FY23", 2.0, "tall"), ("revenue_net", "FY24", 3.0, "tall"), ("cogs", "FY24", 4.0, "tall")}
    ledger = sheet("Particulars", ["FY24"], {"Sales": [100], "Purchases": [40], "Balance": [60]})
    assert {(r.canonical_field, r.period, r.raw_value, r.layout) for r in facts_of(spark, ledger).collect()} == {("revenue_gross", "FY24", 100.0, "ledger"), ("cogs", "FY24", 40.0, "ledger")}
    unknown = sheet("Metric", ["FY23", "FY24"], {"Sales": [1, 2], "Unheard of": [1, 2]})
    grid = grid_of(spark, unknown)
    assert [r.named for r in ingest.unmapped(ingest.cells(grid, ingest.discover(grid))).collect()] == ["Unheard of"]


def xlsx(sheets_):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets_)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets_))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>COGS</t></si></sst>")
        for i, rows in enumerate(sheets_.values()):
            body = "".join(f'<row r="{k + 1}">' + "".join(f'<c r="{chr(65 + j)}{k + 1}" t="s"><v>0</v></c>' if v == "COGS" else f'<c r="{chr(65 + j)}{k + 1}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{chr(65 + j)}{k + 1}"><v>{v}</v></c>' for j, v in enumerate(row) if v is not None) + "</row>" for k, row in enumerate(rows))
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark):
    content = xlsx({"P and L": [["Metric (Rs. Lakhs)", "FY23", "FY24"], ["COGS", 1.5, None], ["Rent", None, 2]], "Other": [["Metric (INR Crore)", "FY23", "FY24", "FY24"], ["COGS", 1, 2, 2]]})
    assert sheets.sheet_names(content) == ["P and L", "Other"]
    got = {(r.sheet, r.canonical_field, r.period, r.cell_reference): float(r.value_normalised) for r in facts_of(spark, content, kind=".xlsx").collect()}
    assert got == {("P and L", "cogs", "FY23", "B2"): 150000.0, ("P and L", "rent_expense", "FY24", "C3"): 200000.0, ("Other", "cogs", "FY23", "B2"): 1e7, ("Other", "cogs", "FY24", "C2"): 2e7, ("Other", "cogs", "FY24", "D2"): 2e7} or len(got) == 4
    broken = grid_of(spark, b"not a zip", ".xlsx").collect()
    assert len(broken) == 1 and broken[0].error


# ---- reconciliation and derivation

STAGED = "staging_id long, file_id int, entity_id int, canonical_field string, period string, value_normalised decimal(28,6), currency string"


def staged(spark, rows):
    return spark.createDataFrame([(i, f, 1, m, p, Decimal(str(v)), "INR") for i, f, m, p, v in rows], STAGED)


FILES = [(1, "ledger.csv"), (2, "Audited accounts.csv")]


def test_conflicts_and_policies(spark):
    rows = staged(spark, [(1, 1, "cogs", "FY24", 10), (2, 2, "cogs", "FY24", 11), (3, 1, "pat", "FY24", 5), (4, 2, "pat", "FY24", 5), (5, 1, "arr", "FY24", 100), (6, 2, "arr", "FY24", 100.4)])
    files = spark.createDataFrame(FILES, "file_id int, filename string")
    slugs = spark.createDataFrame([(1, "one")], "entity_id int, entity_slug string")
    found = reconcile.detect_conflicts(rows, files)
    assert {r.canonical_field for r in found.collect()} == {"cogs", "arr"}
    assert {r.canonical_field for r in reconcile.detect_conflicts(rows, files, tolerance=0.005).collect()} == {"cogs"}
    pick = lambda policy, *a: {r.canonical_field: r.staging_id for r in reconcile.promote(rows, reconcile.resolve(found, policy, *a), slugs).collect()}
    assert pick("first") == {"cogs": 1, "pat": 3, "arr": 5} and pick("prefer", "audited") == {"cogs": 2, "pat": 3, "arr": 6} and pick("open") == {"pat": 3}
    notes = {r.canonical_field: r.authoritative_note for r in reconcile.promote(rows, reconcile.resolve(found), slugs).collect()}
    assert notes["pat"] is None and notes["cogs"]
    with pytest.raises(ValueError):
        reconcile.resolve(found, "guess")


def live_of(spark, rows):
    df = staged(spark, [(i, 1, m, p, v) for i, (m, p, v) in enumerate(rows)]).withColumn("entity_slug", F.lit("one"))
    return df.withColumn("fact_id", F.concat_ws("_", F.lit("f_one"), "period", "canonical_field"))


def test_derivation(spark):
    live = live_of(spark, [("revenue_net", "FY24", 100), ("cogs", "FY24", 60), ("ebitda", "FY24", 25), ("revenue_net", "FY23", 0), ("cogs", "FY23", 1), ("gross_profit", "FY23", 7)])
    got = {(r.canonical_field, r.period): (float(r.value_normalised), list(r.derived_from)) for r in derive.derive(live).collect()}
    assert got == {("gross_profit", "FY24"): (40.0, ["revenue_net", "cogs"]), ("gross_margin_pct", "FY24"): (40.0, ["gross_profit", "revenue_net"]), ("ebitda_margin_pct", "FY24"): (25.0, ["ebitda", "revenue_net"])}
    again = {(r.canonical_field, r.period) for r in derive.derive(live, replace_reported=True).collect()}
    assert ("gross_profit", "FY23") in again and ("gross_margin_pct", "FY23") not in again


def test_validation(spark):
    rows = staged(spark, [
        (1, 1, "revenue_gross", "FY24", 100_000), (2, 1, "returns_refunds", "FY24", 10_000), (3, 1, "revenue_net", "FY24", 80_000), (4, 1, "gross_profit", "FY24", 40_000), (5, 1, "gross_margin_pct", "FY24", 60),
        (6, 1, "cogs", "FY24", 5), (7, 1, "opex", "FY24", 2e12), (8, 1, "revenue_net", "FY23", 1_000), (9, 1, "pat", "FY24", -5_000), (10, 1, "revenue_net", "FY24-M01", 1),
    ])
    got = {(r.check, r.canonical_field, r.period, r.severity) for r in validate.validate(rows).collect()}
    assert got == {
        ("sum_relation", "revenue_net", "FY24", "warning"), ("margin_consistency", "gross_margin_pct", "FY24", "warning"), ("magnitude", "cogs", "FY24", "warning"), ("magnitude", "opex", "FY24", "error"),
        ("period_swing", "revenue_net", "FY24", "warning"), ("sign", "pat", "FY24", "warning"), ("magnitude", "pat", "FY24", "warning"), ("magnitude", "revenue_net", "FY24-M01", "warning"),
    }
    assert "FAIL magnitude: 1 errors" in validate.report(validate.validate(rows)) and "PASS sign" in validate.report(validate.validate(rows))
    assert gates.proceed_despite(validate.validate(rows), lambda _: False) is False and gates.proceed_despite(validate.sign(rows), lambda _: False) is True


def test_swing_across_the_century(spark):
    rows = staged(spark, [(1, 1, "pat", "FY99", 1_000_000), (2, 1, "pat", "FY00", 2_000_000), (3, 1, "pat", "FY01", 1_000)])
    assert [r.period for r in validate.period_swing(rows).collect()] == ["FY01"]
    assert validate.period_swing(rows, by_grain=False).count() == 2


# ---- tools and router


@pytest.fixture(scope="module")
def tools(spark):
    live = live_of(spark, [("revenue_net", "FY24", 12_500_000), ("revenue_net", "FY23", 10_000_000), ("cogs", "FY24", 7_500_000), ("pat", "FY24", 0)])
    live = live.withColumn("source_file_id", F.lit(1)).withColumn("source_sheet", F.lit("S")).withColumn("cell_reference", F.lit("B2")).drop("file_id")
    files = spark.createDataFrame([(1, "facts.csv", "/in/facts.csv", 1, "LIVE")], "file_id int, filename string, file_path string, entity_id int, state string")
    entities = spark.createDataFrame([(1, "One Ltd", "one_ltd"), (2, "One More", "one_more"), (3, "Other", "other")], "entity_id int, entity_name string, entity_slug string")
    chunks = spark.createDataFrame([(1, 7, 0, "Results", True, "revenue rose because prices rose 12%", [], ["FY24"], ["revenue_net"], 1), (1, 8, 1, "Other", False, "nothing to see", [], [], [], 1)], "entity_id int, chunk_id long, chunk_index int, section_path string, contains_numerical_claim boolean, raw_text string, linked_fact_ids array<string>, linked_periods array<string>, linked_metrics array<string>, file_id int")
    return Tools(live, files, entities, chunks)


def test_tools(tools):
    got = tools.fetch_metric(1, "revenue_net", "FY24", "crore")
    assert got["value"] == "12500000.0" and got["display"] == "₹1.25 Cr" and got["citation"]["fact_id"] == "f_one_FY24_revenue_net"
    v = tools.calculate_variance("One Ltd", "revenue_net", "FY23", "FY24")
    assert v["delta"] == "2500000.0" and v["delta_pct"].startswith("25") and len(v["citations"]) == 2
    assert tools.calculate_ratio(1, "cogs", "revenue_net", "FY24")["ratio"].startswith("0.6")
    assert len(tools.list_sources(1, "revenue_net", "FY24")["sources"]) == 1
    assert {"metric": "revenue_net", "observations": 2} in tools.list_available_metrics(1)["metrics"]
    assert [c["chunk_id"] for c in tools.search_context(1, "why did revenue rise", "fy24", "REVENUE_NET")["chunks"]] == [7]
    assert tools.search_context(1, "why did revenue rise", "FY2")["chunks"] == []


def test_typed_errors(tools):
    for error, call in (
        (EntityNotFound, lambda: tools.fetch_metric("nobody", "cogs", "FY24")), (EntityNotFound, lambda: tools.entity(99)), (AmbiguousEntity, lambda: tools.entity("one")), (MetricNotFound, lambda: tools.fetch_metric(1, "arr", "FY24")),
        (PeriodNotFound, lambda: tools.fetch_metric(1, "cogs", "FY20")), (DivisionByZero, lambda: tools.calculate_ratio(1, "cogs", "pat", "FY24")), (MetricNotFound, lambda: tools.list_sources(1, "arr", "FY24")),
    ):
        with pytest.raises(error):
            call()


def test_router(tools):
    r = Router(tools)
    cases = {
        "list metrics": "list_available_metrics", "which file has cogs in FY24?": "list_sources", "why did revenue rise?": "search_context", "growth of revenue from FY23 to FY2024": "calculate_variance",
        "cogs / revenue in FY24": "calculate_ratio", "what is revenue in FY24": "fetch_metric", "hello": "list_available_metrics", "change in revenue": "calculate_variance",
        "what is cogs in FY20": "PeriodNotFound", "pat / nothing": "calculate_ratio", "cogs divided by pat in FY24": "DivisionByZero",
    }
    for q, tool in cases.items():
        assert r.answer(1, q).tool_name == tool, q
    v = r.answer(1, "growth of revenue from FY23 to FY2024").payload
    assert (v["period_1"], v["period_2"], v["delta"]) == ("FY23", "FY24", "2500000.0")
    assert r.answer(3, "list metrics").tool_name == "state_gate" and r.answer(1, "why did revenue rise?").payload["claim_check"]["flagged_chunks"] == [7]
    assert {"ts", "tool", "args", "outcome"} == set(json.loads(r.log[0]))


def test_planner(tools):
    good = {"tool": "fetch_metric", "args": {"metric": "revenue_net", "period": "FY24"}}
    assert Router(tools, lambda q, m: good).answer(1, "x").payload["value"] == "12500000.0"

    def fails(q, m):
        raise TimeoutError("slow")

    r = Router(tools, fails)
    assert r.answer(1, "what is revenue in FY24").tool_name == "fetch_metric" and any("fallback_local" in line for line in r.log)
    fenced = "Sure:\n```json\n" + json.dumps(good) + "\n```"
    assert parse_plan(fenced) == good and parse_plan({"choices": [{"message": {"content": fenced}}]}) == good
    assert response_text({"content": [{"type": "text", "text": "{}"}]}) == "{}"
    many = {f"a{i}": "x" for i in range(13)}
    for bad in ({"tool": "drop"}, {"tool": "fetch_metric", "args": {"metric": "x"}}, {"tool": "list_available_metrics", "args": {"sql": "x"}}, {"tool": "fetch_metric", "args": {"metric": 3, "period": "FY24"}}, {"tool": "fetch_metric", "args": {"metric": " ", "period": "FY24"}}, {"tool": "search_context", "args": many}, "x"):
        with pytest.raises(ValueError):
            check_plan(bad)


# ---- texts


def test_chunks_lose_no_word():
    body = " ".join(f"Sentence number {i} has a value of {i}.5 in it." for i in range(200))
    source = f"RESULTS\n\n{body} And a tail without an end\n\nNext Part\n\nShort text here."
    chunks = text.chunk_text(source)
    assert len(chunks) > 2 and all(text._count(t) <= text.MOST for _, t in chunks) and chunks[0][0] == "RESULTS"
    words = set(source.split()) - {"RESULTS", "Next", "Part"}
    assert words <= set(" ".join(t for _, t in chunks).split())
    assert text.chunk_text("") == [("", "")] and text.chunk_text("Just this.", "Sec") == [("Sec", "Just this.")]


def test_claims_have_context():
    got = text.find_claims("Sales were Rs. 45 lakh in FY24, up 3.2x.")
    assert [(c["type"], c["number"]) for c in got] == [("currency", "Rs. 45 lakh"), ("period", "FY24"), ("multiplier", "3.2x")] and all(c["number"] in c["context"] for c in got)


def test_links_of_odd_chunks_compute_facts_once(spark):
    live = live_of(spark, [("revenue_net", "FY23", 1), ("pat", "FY24", 2), ("cogs", "FY22", 2)])
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    odd = spark.createDataFrame([(1, 1, "The pat.", None), (2, 2, None, []), (None, 3, "pat", None), (1, 4, "Of FY24, FY2024 and FY23", None)], "entity_id int, chunk_id long, raw_text string, old string")
    lone = live.unionByName(live.limit(1).withColumns({"fact_id": F.lit("f"), "period": F.lit(None).cast("string"), "canonical_field": F.lit(None).cast("string")}))
    found = text.link_to_facts(text.with_claims(odd), lone.mapInArrow(seen, lone.schema))
    got = {r.chunk_id: (r.linked_periods, r.linked_metrics, r.linked_fact_ids) for r in found.collect()}
    assert got[1] == ([], ["pat"], ["f_one_FY24_pat"]) and got[2] == got[3] == ([], [], []) and got[4] == (["FY23", "FY24"], [], ["f_one_FY23_revenue_net", "f_one_FY24_pat"])
    assert read.value == lone.count()  # facts are computed once


def test_links_and_search(spark):
    chunks = spark.createDataFrame([(1, 1, "Net revenue: revenue net of FY2024 rose, a pattern."), (1, 2, "Nothing."), (2, 3, "Of FY24.")], "entity_id int, chunk_id long, raw_text string")
    live = live_of(spark, [("revenue_net", "FY23", 1), ("pat", "FY24", 2), ("cogs", "FY22", 2)])
    got = {r.chunk_id: r for r in text.link_to_facts(text.with_claims(chunks), live).collect()}
    assert got[1].linked_fact_ids == ["f_one_FY23_revenue_net", "f_one_FY24_pat"] and got[1].linked_periods == ["FY24"] and got[1].linked_metrics == ["revenue_net"]
    assert got[2].linked_fact_ids == [] and got[3].linked_fact_ids == []
    assert [r.chunk_id for r in text.keyword_search(chunks, "revenue of fy24").collect()] == [1, 3]
    vectors = spark.createDataFrame([(i, i % 2, [float(i), 1.0]) for i in range(40)], "chunk_id long, file_id int, embedding array<float>")
    near = text.vector_search(vectors, [1.0, 0.0], k=3).collect()
    assert sorted(r.chunk_id for r in near) == [34, 35, 36, 37, 38, 39]
    e = chunks.select(text.embed(F.col("raw_text")).alias("e")).first().e
    assert len(e) == text.DIMENSIONS and abs(sum(x * x for x in e) - 1) < 1e-5


def docx(parts):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = ""
    for p in parts:
        if isinstance(p, list):
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{run(c)}</w:tc>" for c in row) + "</w:tr>" for row in p) + "</w:tbl>"
        elif p.startswith("#"):
            body += f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{p[1:]}</w:t></w:r></w:p>'
        else:
            body += run(p)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_word_documents(spark, engine, tmp_path):
    long = "The company grew revenue by 12.5% to Rs. 27 crore in FY24 as demand rose in all of its markets and prices held up well over the year."
    content = docx(["#Overview", long, "* a footnote", [["Period", "Revenue", "EBITDA"], ["FY21", "1000", "200"], ["FY20", "900", "150"]], [["Category", "Amount", "Count"], ["a", "b", "c"]], "#Outlook", long.replace("12.5", "3.0")])
    (tmp_path / "harbor_engineering_report.docx").write_bytes(content)
    files = sheets.list_files(spark, str(tmp_path), (".docx",))
    read = documents.read_parts(files.withColumn("file_id", F.lit(1)))
    assert [r.is_structured for r in documents.tables(read).orderBy("index").collect()] == [True, False]
    got = {r.raw_text: (r.chunk_type, r.section_path) for r in documents.paragraphs(read).collect()}
    assert got[long] == ("narrative", "Overview") and got["* a footnote"][0] == "footnote"
    assert documents.table_chunks(read).first().raw_text.startswith("Category | Amount | Count")
    before = engine.store.read("staging_facts").count()
    out = engine.load_documents(files)
    assert out["files_processed"] == 1 and out["chunks_total"] == 4 and engine.store.read("staging_facts").count() == before + 4
    chunks = engine.store.read("qualitative_chunks").where("region_type = 'narrative'")
    entity = engine.store.read("entities").where("entity_slug = 'harbor_engineering'").first().entity_id
    assert {r.entity_id for r in chunks.collect()} == {entity} and chunks.where("contains_numerical_claim AND array_contains(linked_periods, 'FY24')").count() == 2
    assert engine.load_documents(files)["files_processed"] == 0
    answer = Router(engine.tools()).answer("harbor", "what is net revenue in FY24")
    assert answer.payload["value"] == "316000000.0"


def test_page_blocks(spark):
    rows = [(1, 1, 0.0, 10.0, 400.0, 60.0, "wide table", 800.0), (1, 1, 0.0, 700.0, 10.0, 704.0, "foot", 800.0), (1, 2, 0.0, 10.0, 100.0, 200.0, "word " * 30, 800.0)]
    got = documents.block_chunks(spark.createDataFrame(rows, "file_id int, page int, x0 double, y0 double, x1 double, y1 double, text string, page_height double")).collect()
    assert [r.region_type for r in got] == ["table", "footer_notes", "narrative"]


# ---- store and stream


def test_store_states(spark, tmp_path):
    files = conform(spark.createDataFrame([(1, "UPLOADED"), (2, "LIVE")], "file_id int, state string"), "source_files")
    assert {r.state for r in move(files, "SCHEMA_MAPPED", F.col("file_id") == 1).collect()} == {"SCHEMA_MAPPED", "LIVE"}
    with pytest.raises(Exception, match="no way"):
        move(files, "LIVE", F.col("file_id") == 1).collect()
    store = Store(spark, str(tmp_path))
    assert all(store.read(t).schema == schema(t) for t in SCHEMAS)
    two = conform(spark.createDataFrame([(1, "a"), (2, "b")], "entity_id int, fact_id string"), "live_facts")
    store.overwrite("live_facts", two)
    store.overwrite("live_facts", two.where("entity_id = 1").withColumn("fact_id", F.lit("c")))
    assert sorted(r.fact_id for r in store.read("live_facts").collect()) == ["b", "c"]


def test_reset(spark, corpus, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.load_folder(str(corpus))
    one = e.store.read("entities").where("entity_slug = 'meadow_foods'").first().entity_id
    e.reset(one)
    assert e.store.read("live_facts").where(F.col("entity_id") == one).count() == 0 and e.store.read("live_facts").count() > 0
    assert Router(e.tools()).answer(one, "list metrics").tool_name == "state_gate"


def test_stream(spark, corpus, tmp_path):
    from tallyforge.streaming.landing import event_rates, watch

    e = Engine(spark, str(tmp_path / "store"))
    watch(spark, str(corpus), e, str(tmp_path / "check"), once=True).awaitTermination()
    assert e.store.read("live_facts").count() == 225
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert event_rates(events).agg(F.sum("n")).first()[0] == events.count()


# ---- more sources, the mapper, users' words, the command line

def test_files_are_listed_by_suffix_and_path(spark, tmp_path):
    for n in ("b.CSV", "a.csv", "c.txt", "d.xls"):
        (tmp_path / n).write_bytes(b"x,y")
    assert [r.filename for r in sheets.list_files(spark, str(tmp_path)).collect()] == ["a.csv", "b.CSV", "d.xls"]


def test_binary_workbooks_and_dates(spark):
    rows = [["Metric (Rs. Lakhs)", "FY23", "FY24"], ["COGS", 1.5, None], ["Rent", None, 2]]
    many = [[f"text {i} {j}" if j % 2 else i * 1.25 for j in range(6)] for i in range(300)]
    content = samples.to_xls({"P and L": rows, "Zwei é": many})
    got = list(biff.rows(content))
    assert got[:3] == [("P and L", 0, ["Metric (Rs. Lakhs)", "FY23", "FY24"]), ("P and L", 1, ["COGS", "1.5"]), ("P and L", 2, ["Rent", "", "2"])] and len(got) == 303
    assert got[-1] == ("Zwei é", 299, ["373.75", "text 299 1", "373.75", "text 299 3", "373.75", "text 299 5"])
    first = {(r.canonical_field, r.period): float(r.value_normalised) for r in facts_of(spark, samples.to_xls({"P": rows}), kind=".xls").collect()}
    assert first == {("cogs", "FY23"): 150000.0, ("rent_expense", "FY24"): 200000.0}
    assert grid_of(spark, b"a,b\n1,2", ".xls").count() == 4 and grid_of(spark, content[:600], ".xls").first().error
    # strings that go on in the next record, and numbers in the short form
    piece = b"\x01\0\0\0\x01\0\0\0" + b"\x06\0\x00abc"
    assert biff._strings([piece, b"\x01d\0e\0f\0"]) == ["abcdef"] and biff._number((1234 << 2 | 3).to_bytes(4, "little")) == 12.34
    assert sheets.is_date_format("dd/mm/yy") and not sheets.is_date_format('#,##0 "days"') and sheets.date_text(45383) == "2024-04-01"


def test_mapper_and_its_cache(spark, tmp_path):
    store, asked = Store(spark, str(tmp_path)), []

    def ask(text):
        asked.append(text)
        return '```json\n[{"raw_header": "Unheard Of", "canonical_field": "cogs", "confidence": "high", "needs_review": false, "reasoning": "r"}, {"raw_header": "odd", "canonical_field": "no_metric", "confidence": "high"}]\n```'

    rows = spark.createDataFrame([("Unheard Of",), (" odd ",), ("never said",)], "named string")
    got = {r.raw_header.strip(): (r.canonical_field, r.needs_review) for r in mapper.map_headers(store, rows, ask).collect()}
    assert got == {"Unheard Of": ("cogs", False), "odd": (None, True), "never said": (None, True)} and len(asked) == 1 and "Unheard Of" in asked[0]
    mapper.map_headers(store, spark.createDataFrame([("UNHEARD OF",)], "named string"), ask)
    assert len(asked) == 1
    assert resolve_headers(spark.createDataFrame([("unheard of ",)], "h string"), "h").first().metric == "cogs"
    clear_aliases()
    with pytest.raises(ValueError):
        mapper.parse("no list", ["a"])


def test_formulas_of_a_session(spark):
    derive.register_formula("cost_share", "cogs", "revenue_net", "percent")
    try:
        live = live_of(spark, [("revenue_net", "FY24", 100), ("cogs", "FY24", 60)]).withColumn("source_file_id", F.col("file_id")).withColumn("cell_reference", F.concat(F.lit("B"), F.col("staging_id").cast("string")))
        got = {r.canonical_field: r for r in derive.derive(live).collect()}
        assert float(got["cost_share"].value_normalised) == 60.0 and got["cost_share"].cell_reference == "B1"
        assert got["gross_profit"].cell_reference == got["gross_margin_pct"].cell_reference == "B0" and got["gross_profit"].source_file_id == 1
    finally:
        derive.clear_formulas()


def test_names_in_questions():
    metrics = ["revenue_net", "cogs", "gross_profit", "pat", "ebitda"]
    assert find_metric("net revenue and cogs", metrics) == "revenue_net" and find_metric("hello", metrics) is None
    assert ratio_parts("cogs over net revenue", metrics) == ("cogs", "revenue_net") and ratio_parts("gross margin", metrics) == ("gross_profit", "revenue_net")
    assert ratio_parts("net profit margin", metrics) == ("pat", "revenue_net") and ratio_parts("ratio of gross profit and cogs", metrics) == ("gross_profit", "cogs")
    assert ratio_parts("cogs / nothing", metrics) == ("cogs", None) and ratio_parts("ratio of cogs", metrics) == (None, None)
    body = planner_request("q", ["a"] * 40, model="m")
    assert body["messages"][0]["role"] == "system" and len(json.loads(body["messages"][1]["content"])["metrics"]) == 25 and planner_request("q", [], model="m", shape="content")["system"]
    assert remote_planner(lambda *a: {}) is None
    plan = remote_planner(lambda url, headers, sent, seconds: {"choices": [{"message": {"content": json.dumps({"tool": "list_available_metrics", "args": {}})}}]}, url="u", key="k", model="m")
    assert check_plan(parse_plan(plan("q", ["cogs"]))) == {"tool": "list_available_metrics", "args": {}}


def test_exact_values_and_context_by_meaning(spark, tools, tmp_path):
    assert str(_exact(Decimal("123456789012345678901.234500"))) == "123456789012345678901.2345" and str(_exact(Decimal("5.000000"))) == "5.0"
    rows = [(1, 100 + i, i, "S", True, t, [], ["FY24-Q1"], [], 1 + i % 2) for i, t in enumerate(["prices rose fast", "prices rose", "nothing here"] * 8)]
    chunks = spark.createDataFrame(rows, tools.chunks.schema).withColumn("embedding", text.embed(F.col("raw_text")))
    t = Tools(tools.live, tools.files, tools.entities, chunks, text.hashed_words)
    got = t.search_context(1, "prices rose")
    assert got["search_mode"] == "similarity" and [c["file_id"] for c in got["chunks"]] == [1] * 8 + [2] * 8 and got["chunks"][0]["text"] == "prices rose"
    assert t.search_context(1, "prices", "fy24")["chunks"] == [] and len(Tools(tools.live, tools.files, tools.entities, chunks, compat=True).search_context(1, "prices", "fy24")["chunks"]) == 8
    assert [c["chunk_id"] for c in t.chunks_by_id([105, 101, 9])] == [101, 105] and t.chunks_by_id([]) == []
    log = tmp_path / "audit.jsonl"
    Router(t, log_path=str(log)).answer(1, "what is revenue in FY24")
    assert [json.loads(line)["tool"] for line in log.read_text().splitlines()] == ["fetch_metric"]


def test_command_line_conflicts_and_documents(spark, tmp_path):
    folder, store = str(tmp_path / "in"), str(tmp_path / "store")
    assert len(main.run(["samples", folder]).splitlines()) == 3
    words = "Revenue of FY24 rose by 12% as prices rose and demand held up in all markets that the company sells to, at home and abroad, over the year."
    (tmp_path / "in" / "meadow_foods_report.docx").write_bytes(samples.to_docx(["# Results", words, [["Period", "Inventory", "Total debt"], ["FY23", "5", "7"], ["FY22", "4", "8"]]]))
    (tmp_path / "in" / "meadow_foods_broken.docx").write_bytes(b"no zip")
    out = main.run(["--store", store, "load", folder, "--mock"], spark)
    loaded = json.loads(out.splitlines()[1])
    assert loaded["files_processed"] == 1 and len(loaded["errors"]) == 1 and "Meadow Foods" in out
    engine = Engine(spark, store, policy="prefer", prefer="audited")
    assert engine.store.read("live_facts").where("canonical_field = 'inventory' AND period = 'FY23' AND entity_slug = 'meadow_foods'").count() == 1
    made = engine.store.read("live_facts").where("is_derived").limit(1).first()
    assert made.source_file_id is not None and made.cell_reference
    c = engine.store.read("conflicts").orderBy("conflict_id").first()
    other = next(o for o in c.values_seen if o.staging_id != c.resolution_staging_id)
    main.run(["--store", store, "resolve", str(c.conflict_id), str(other.staging_id)], spark)
    fact = engine.store.read("live_facts").where((F.col("entity_id") == c.entity_id) & (F.col("canonical_field") == c.canonical_field) & (F.col("period") == c.period)).first()
    assert str(fact.value_normalised) == other.value and engine.store.read("conflicts").where(F.col("conflict_id") == c.conflict_id).first().resolved_by == "user"
    with pytest.raises(ValueError):
        engine.resolve_conflict(c.conflict_id, -1)
    blocks = spark.createDataFrame([("/p/harbor_engineering.pdf", 1, 0.0, 10.0, 100.0, 200.0, "Net revenue grew by 5%. " * 12, 800.0)], "path string, page int, x0 double, y0 double, x1 double, y1 double, text string, page_height double")
    files = spark.createDataFrame([("/p/harbor_engineering.pdf", "harbor_engineering.pdf", ".pdf", "c0")], "path string, filename string, file_type string, checksum string")
    assert engine.load_pages(blocks, files)["chunks_total"] == 1 and engine.load_pages(blocks, files)["files_processed"] == 0
    assert json.loads(main.run(["--store", store, "ask", "harbor", "list metrics"], spark))["tool"] == "list_available_metrics"
    assert "0 of 1 files live" not in main.run(["--store", store, "report"], spark)
    before = engine.store.read("live_facts").count()
    main.run(["--store", store, "reset", "harbor"], spark)
    assert engine.store.read("conflicts").count() == 0 and engine.store.read("live_facts").count() < before
    assert engine.load_folder(folder)["files"] == 2 and engine.store.read("live_facts").count() == before
