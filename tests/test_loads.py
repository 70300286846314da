"""Loads that fail, clash, are refused or come twice, and total rows held against their lines."""

import random
import threading
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import gates, ingest, totals
from tallyforge.operators.pipeline import Engine
from tallyforge.operators.store import SCHEMAS, Clash, Store, conform
from tallyforge.sources import samples, sheets
from tallyforge.streaming.landing import watch


@pytest.fixture(autouse=True)
def few_tasks(spark):
    """Loads of a few rows are made of many small jobs."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def csv(folder, name, **values):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("Metric (Rs. Lakhs),FY23,FY24\n" + "\n".join(f"{k.replace('_', ' ')},{a},{b}" for k, (a, b) in values.items()))


def content(store):
    """What a store holds, without ids and times."""
    names = store.read("source_files").select("file_id", "filename", "state", "checksum")
    slugs = store.read("entities").select("entity_id", "entity_slug", "entity_name")
    staged = store.read("staging_facts").join(names, "file_id").join(slugs, "entity_id").select("filename", "entity_slug", "canonical_field", "period", "value_normalised", "cell_reference")
    live = store.read("live_facts").select("fact_id", "value_normalised", "is_derived", "cell_reference")
    notes = store.read("qualitative_chunks").join(names, "file_id").select("filename", "raw_text")
    log = store.read("ingestion_log").select("event", "detail")
    conflicts = store.read("conflicts").join(slugs, "entity_id").select("entity_slug", "canonical_field", "period", "state")
    return {k: sorted(map(str, d.collect())) for k, d in {"files": names.drop("file_id"), "entities": slugs.drop("entity_id"), "staged": staged, "live": live, "notes": notes, "log": log, "conflicts": conflicts}.items()}


class Broken(Exception):
    pass


def test_a_load_that_fails_at_any_write_leaves_nothing_and_is_done_again(spark, tmp_path, monkeypatch):
    csv(tmp_path / "in", "acme_audited.csv", Revenue=(10, 20), COGS=(4, 9), Total_zzz=(4, 80))
    csv(tmp_path / "in", "acme_mis.csv", Revenue=(10, 21))
    clean = Engine(spark, str(tmp_path / "clean"))
    assert clean.load_folder(str(tmp_path / "in"))["totals_off"] == 1
    want = content(clean.store)
    engine = Engine(spark, str(tmp_path / "store"))
    write, put = Store._write, Store._put
    calls, fail_at = [0], [0]

    def counted(f):
        def run(self, *args):
            out = f(self, *args)
            calls[0] += "_ids" not in str(args[0])
            if calls[0] == fail_at[0]:
                raise Broken
            return out

        return run

    monkeypatch.setattr(Store, "_write", counted(write))
    monkeypatch.setattr(Store, "_put", lambda self, path, what: counted(put)(self, path, what) if "_ids" in path else put(self, path, what))
    failures = 0
    while True:
        calls[0], fail_at[0] = 0, fail_at[0] + 1
        try:
            out = engine.load_folder(str(tmp_path / "in"))
            break
        except Broken:
            failures += 1
            assert all(not engine.store.read(t).limit(1).count() for t in SCHEMAS)
    assert failures >= 8 and out["files"] == 2 and content(engine.store) == want
    assert engine.load_folder(str(tmp_path / "in"))["files"] == 0 and content(engine.store) == want
    assert engine.store.vacuum(0) >= failures and content(engine.store) == want


def test_a_load_that_fails_before_its_commit_is_out_of_sight(spark, tmp_path, monkeypatch):
    csv(tmp_path / "in", "acme.csv", Revenue=(1, 2))
    engine = Engine(spark, str(tmp_path / "store"))

    def no(self):
        raise Broken

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", no)
        with pytest.raises(Broken):
            engine.load_folder(str(tmp_path / "in"))
    assert engine.store.read("live_facts").count() == 0 and engine.load_folder(str(tmp_path / "in"))["live"] == 2


def test_two_loads_at_once(spark, tmp_path):
    csv(tmp_path / "a", "acme_audited.csv", Revenue=(10, 20), COGS=(4, 9))
    csv(tmp_path / "b", "acme_mis.csv", Revenue=(10, 21), Rent=(1, 2))
    engines, errors = [Engine(spark, str(tmp_path / "store")) for _ in range(2)], []

    def load(engine, folder):
        try:
            engine.load_folder(str(tmp_path / folder))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=load, args=x) for x in zip(engines, "ab")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    store = Store(spark, str(tmp_path / "store"))
    assert not errors and store.read("entities").count() == 1
    for table, key, n in (("source_files", "file_id", 2), ("staging_facts", "staging_id", 8)):
        ids = [r[0] for r in store.read(table).select(key).collect()]
        assert len(ids) == len(set(ids)) == n
    live = {(r.canonical_field, r.period) for r in store.read("live_facts").collect()}
    assert ("rent_expense", "FY24") in live and ("cogs", "FY24") in live and [r.period for r in store.read("conflicts").collect()] == ["FY24"]


def test_loads_that_clash(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = conform(spark.createDataFrame([(1, "a")], "entity_id int, fact_id string"), "live_facts")
    one, two, three = store.begin("x"), store.begin("x"), store.begin("y")
    one.overwrite("live_facts", rows)
    assert one.read("live_facts").count() == 1 and store.read("live_facts").count() == 0 == two.read("live_facts").count()
    one.commit()
    assert store.read("live_facts").count() == 1 and two.read("live_facts").count() == 0 and store.begin("x") is None
    for load in (two, three):  # the same name, the same entity
        load.overwrite("live_facts", rows if load is three else rows.withColumn("entity_id", F.lit(2)))
        with pytest.raises(Clash):
            load.commit()
    other = store.begin("z")
    other.overwrite("live_facts", rows.withColumn("entity_id", F.lit(3)))
    store.overwrite("live_facts", rows.withColumn("fact_id", F.lit("b")))
    other.commit()  # others have loaded another entity meanwhile
    assert sorted((r.entity_id, r.fact_id) for r in store.read("live_facts").collect()) == [(1, "b"), (3, "a")]
    assert store.vacuum(0) == 5 and store.read("live_facts").count() == 2


def test_ids_are_reserved_once(spark, tmp_path):
    stores, got = [Store(spark, str(tmp_path)) for _ in range(4)], []

    def take(store):
        got.extend((store.reserve("x", n), n) for n in (3, 1, 5))

    threads = [threading.Thread(target=take, args=(s,)) for s in stores]
    [t.start() for t in threads]
    [t.join() for t in threads]
    ids = [i for first, n in got for i in range(first, first + n)]
    assert sorted(ids) == list(range(1, 4 * 9 + 1))


def test_a_chunk_put_again_replaces_the_one_before(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(r, "chunk_id long, file_id int, entity_id int, raw_text string, metadata map<string, string>")
    assert store.upsert("qualitative_chunks", rows((1, 1, 1, "old", {"page": "1"}), (2, 1, 1, "same", None)), "chunk_id") == 2
    store.upsert("qualitative_chunks", rows((1, 1, 1, "new", {"page": "2"}), (3, 1, 1, "more", None)), "chunk_id")
    got = {r.chunk_id: (r.raw_text, r.metadata) for r in store.read("qualitative_chunks").collect()}
    assert got == {1: ("new", {"page": "2"}), 2: ("same", None), 3: ("more", None)}


def test_refused_files_stay_out_until_they_are_accepted(spark, tmp_path):
    csv(tmp_path / "a", "acme_mis.csv", Revenue=(1, 2))
    csv(tmp_path / "b", "acme_audited.csv", COGS=(3, 4))
    refusing, engine = Engine(spark, str(tmp_path / "store"), gate=lambda _: False), Engine(spark, str(tmp_path / "store"))
    assert refusing.load_folder(str(tmp_path / "a"))["live"] == 0
    assert engine.load_folder(str(tmp_path / "b"))["live"] == 2  # not what was refused, though of the same entity
    states = lambda: {r.filename: (r.file_id, r.state) for r in engine.store.read("source_files").collect()}
    first = states()["acme_mis.csv"][0]
    assert states()["acme_mis.csv"][1] == "AWAITING_ACKNOWLEDGMENT" and {r.canonical_field for r in engine.store.read("live_facts").collect()} == {"cogs"}
    engine.reject([first])
    assert states()["acme_mis.csv"][1] == "REJECTED" and engine.store.read("live_facts").count() == 2
    assert engine.reconcile([first])["live"] == 8 and states()["acme_mis.csv"][1] == "LIVE"  # with gross profit and its margin


def test_unreadable_files_make_no_entity(spark, tmp_path):
    csv(tmp_path / "in", "acme.csv", Revenue=(1, 2))
    (tmp_path / "in" / "broken_company.xlsx").write_bytes(b"PK\x03\x04 no workbook")
    engine = Engine(spark, str(tmp_path / "store"))
    out = engine.load_folder(str(tmp_path / "in"))
    assert out["files"] == 1 and len(out["errors"]) == 1
    assert [r.entity_slug for r in engine.store.read("entities").collect()] == ["acme"] and engine.store.read("source_files").count() == 1
    # a file that fails after rows of it were given out
    late = samples.to_xlsx({"S1": [["Metric", "FY23", "FY24"]] + [[f"m{i}", "1", "2"] for i in range(20_000)], "S2": [["x"]]})
    spoilt = late.replace(b"worksheets/s1.xml", b"worksheets/s9.xml")
    (tmp_path / "in" / "late_company.xlsx").write_bytes(spoilt)
    again = engine.load_folder(str(tmp_path / "in"))
    assert again["files"] == 0 and len(again["errors"]) == 2 and engine.store.read("entities").count() == 1


def test_a_stream_loads_each_batch_once_and_nothing_but_sheets(spark, tmp_path, monkeypatch):
    csv(tmp_path / "in", "acme.csv", Revenue=(1, 2))
    (tmp_path / "in" / "logo.PNG").write_bytes(b"\x89PNG,a,b\n1,2,3")
    engine = Engine(spark, str(tmp_path / "store"))
    start = lambda: watch(spark, str(tmp_path / "in"), engine, str(tmp_path / "check"), once=True)

    def no(self):
        raise Broken

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", no)
        with pytest.raises(Exception, match="Broken"):
            start().awaitTermination()
    start().awaitTermination()
    assert [r.filename for r in engine.store.read("source_files").collect()] == ["acme.csv"] and engine.store.read("live_facts").count() == 2
    names = [r["name"] for r in engine.store._journal().collect() if r["name"]]
    assert names == [f"{tmp_path / 'check'}#0"]
    csv(tmp_path / "other", "other.csv", Revenue=(5, 6))
    files = sheets.list_files(spark, str(tmp_path / "other"))
    assert engine.load(files, names[0])["files"] == 0 and engine.load(files, "another")["files"] == 1


# ---- totals


def table(spark, rows, header=("Line", "FY24")):
    cells = [(1, "S", i, j, h, None if v is None else str(v)) for i, r in enumerate(rows) for j, (h, v) in enumerate(zip(header, r))]
    return spark.createDataFrame(cells, "file_id int, sheet string, row_idx int, col_idx int, header string, raw string")


def checked(spark, rows):
    return {(r["row_idx"], r["col_idx"]): r for r in totals.check(totals.marked(table(spark, rows))).collect()}


def test_nested_totals(spark):
    rows = [["A", None], ["a1", "1,000"], ["a2", "(200)"], ["Total A", 800], ["B", None], ["b1", 5], ["b2", 0], ["Less: b3", 2], ["Sub-total", 3], ["Grand total", 803], ["", ""], ["c", 7], ["Total", 810], ["d", 1], ["Total", 50]]
    got = checked(spark, rows)
    assert [(k[0], r["status"], r["first_row"], r["n_lines"], r["n_totals"]) for k, r in sorted(got.items())] == [
        (3, "matches", 1, 2, 0), (8, "matches", 5, 3, 0), (9, "matches", 1, 5, 2), (12, "matches", 1, 6, 3), (14, "differs", None, 1, 0),
    ]
    assert got[14, 1]["difference"] == 49


def test_rounded_lines_and_totals_without_lines(spark):
    rows = [["Total", 5], ["x", "0.33"], ["y", "0.33"], ["z", "0.33"], ["Total", "1.00"], ["u", "0.33"], ["Total u", "0.35"]]
    got = checked(spark, rows)
    assert [got[k, 1]["status"] for k in (0, 4, 6)] == ["empty", "matches", "differs"] and got[4, 1]["difference"] == Decimal("0.01")


def brute(column):
    """status and first row of each total, by trying every block."""
    unit = max((len(str(v).partition(".")[2]) for _, v in column if v is not None), default=0)
    half, out = Decimal(10) ** -unit / 2, {}
    is_total = lambda k: column[k][0].startswith("Total")
    for r, (label, value) in enumerate(column):
        if not is_total(r) or value is None:
            continue
        lines = [k for k in range(r) if not is_total(k) and column[k][1] is not None]
        best = None
        for n in range(1, len(lines) + 1):
            first = lines[-n]
            total = sum(Decimal(str(column[k][1])) for k in lines[-n:])
            begins = first == lines[0] or any(is_total(k) or column[k][1] is None for k in range(lines[-n - 1] + 1, first))
            zero = Decimal(str(column[first][1])) == 0
            if (begins or not zero) and abs(Decimal(str(value)) - total) <= half * (n + 1):
                best = max(best or (False, -1), (begins, first))
        out[r] = ("matches", best[1]) if best else ("differs" if lines else "empty", None)
    return out


@pytest.mark.parametrize("part", [1 << 16, 7])
def test_totals_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(totals.running, "__defaults__", (part,))
    r = random.Random(part)
    columns = []
    for _ in range(25):
        column = []
        for _ in range(r.randint(1, 30)):
            kind = r.random()
            if kind < 0.15:
                column.append(("Heading", None))
            elif kind < 0.4 and column:
                lines = [v for label, v in column if label == "line"]
                column.append(("Total", round(sum(lines[-r.randint(0, len(lines)) :] if lines else []) + r.choice([0, 0, 0, 0.1, 3]), 1)))
            else:
                column.append(("line", r.choice([0, 1, 2, 5, -1, 0.5, 10.1])))
        columns.append(column)
    cells = [(k, "S", i, j, "h", None if v is None else str(v)) for k, c in enumerate(columns) for i, row in enumerate(c) for j, v in enumerate(row)]
    df = spark.createDataFrame(cells, "file_id int, sheet string, row_idx int, col_idx int, header string, raw string")
    got = {}
    for x in totals.check(totals.marked(df)).collect():
        got.setdefault(x["file_id"], {})[x["row_idx"]] = (x["status"], x["first_row"])
    assert got == {k: brute(c) for k, c in enumerate(columns) if brute(c)}


def test_short_sheets_alike_by_parts_and_whole_in_one_shuffle(spark):
    r = random.Random(3)
    cells = []
    for k in range(30):
        sheet, own = "ST"[k % 2], [r.choice(["line", "line", "Heading", "Total", "Less: x", "--- x", None, ""]) for _ in range(r.randint(1, 25))]
        for i, label in enumerate(own):
            cells.append((k // 2, sheet, i, 0, "Line", label))
            cells += [(k // 2, sheet, i, j, "h", None if label == "Heading" else r.choice(["1", "2", "0", "-1", "0.33", "3.00", "n/a"])) for j in (1, 2, 5) if r.random() < 0.9]
    df = spark.createDataFrame(cells, "file_id int, sheet string, row_idx int, col_idx int, header string, raw string")
    rows = lambda out: sorted(map(str, out.collect()))
    whole = totals.check(totals.marked(df, whole=True), whole=True)
    assert rows(whole) == rows(totals.check(totals.marked(df))) and {x["status"] for x in whole.collect()} == {"matches", "differs", "empty"}
    assert whole._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1
    assert rows(totals.check(totals.marked(df.limit(0), whole=True), whole=True)) == []


def test_total_rows_shuffles_lines_once(spark, sf):
    from tallyforge.plans.catalogue import QUERIES

    plan = QUERIES["total_rows"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_no_cells_no_totals(spark):
    assert totals.check(totals.marked(table(spark, []))).collect() == [] and checked(spark, [["x", 1]]) == {}
    assert ingest.if_small(spark.range(3), 2).count() == 3 and gates.onboard(None, None, None)
