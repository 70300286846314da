"""Tables of the scalar semantics: periods, units, numbers, headers, references, claims."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import aliases, periods, text, units
from tallyforge.registry import ALIASES, METRICS


def apply(spark, values, f, *more):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"), *more)).collect()]


PERIODS = {
    "FY24": "FY24", "FY2024": "FY24", "fy 24": "FY24", "FY24-M6": "FY24-M06", "FY24_M06": "FY24-M06", "FY24-Q2": "FY24-Q2", "FY24Q2": "FY24-Q2",
    "Q2FY24": "FY24-Q2", "Q2 FY2024": "FY24-Q2", "Apr-23": "FY24-M01", "March 2024": "FY24-M12", "Jan 24": "FY24-M10", "September-2023": "FY24-M06",
    "FY 2023-24": "FY24", "FY2021–2022": "FY22", "FY2023A": "FY23", "FY24E": "FY24", "FY25p": "FY25", "Q1'22": "FY22-Q1", "1-Apr-23 to 31-Mar-24": "FY24",
    "31-Mar-2022": "FY22", "31 Mar 22": "FY22", "30-Apr-2022": "FY23", "31.03.24": "FY24", "31/03/2024": "FY24", "01-04-24": "FY25", "CY2023": "CY2023",
    "cy 2023": "CY2023", "2023": "CY2023", "1999": None, "Total": None, "": None, " FY24 ": "FY24", "x FY24": None, "FY2024-25 to FY26": "FY26",
}


def test_periods(spark):
    assert dict(zip(PERIODS, apply(spark, PERIODS, periods.parse_period))) == PERIODS


def test_canonical_periods_stay(spark):
    known = [p for p in PERIODS.values() if p and not p.startswith("CY")]
    assert apply(spark, known, periods.parse_period) == known


def test_period_labels(spark):
    want = {"FY24": "FY24 (Apr 2023–Mar 2024)", "FY24-M06": "Sep 2023", "FY24-M12": "Mar 2024", "FY24-Q2": "Q2 FY24 (Jul–Sep)", "CY2023": "CY2023"}
    assert dict(zip(want, apply(spark, want, periods.period_label))) == want


UNITS = {
    "Rs. Crore": "INR Crore", "INR cr": "INR Crore", "Rs Lakh": "INR Lakh", "lac": "INR Lakh", "All figures in Rs. Lakhs": "INR Lakh", "INR thousand": "INR Thousand",
    "'000 INR": "INR Thousand", "Rs. million": "INR Million", "INR absolute": "INR", "in INR": "INR", "rupees": "INR", "USD thousand": "USD Thousand", "usd '000": "USD Thousand",
    "USD mn": "USD Million", "$mn": "USD Million", "$bn": "USD Billion", "USD": "USD", "in $": "USD", "$ crore": "INR Crore", "INR mn": "UNKNOWN", "million": "UNKNOWN",
    "ARR ($000s)": "UNKNOWN", "USD usd million": "USD Million", "USD usd lakh": "INR Lakh", "": "UNKNOWN", None: "UNKNOWN",
}


def test_units(spark):
    assert dict(zip(UNITS, apply(spark, UNITS, lambda c: units.detect_unit(c)["label"]))) == UNITS
    more = {"INR mn": "INR Million", "INR crores": "INR Crore", "ARR ($000s)": "USD Thousand"}
    assert dict(zip(more, apply(spark, more, lambda c: units.detect_unit(c, compat=False)["label"]))) == more


def test_normalise_is_exact(spark):
    n = spark.range(1).select(units.normalise(F.lit("31.6").cast("decimal(18,2)"), F.lit("Rs. Crore")).alias("n")).first().n
    assert str(n.value) == "316000000.000000" and (n.currency, n.factor, n.applied) == ("INR", 10_000_000, True)


def test_row_units(spark):
    cases = {"Packaging (Rs absolute)": "INR absolute", "Packaging in Rs": "INR absolute", "Ads (USD mn)": "USD usd mn", "Rent Rs crore": "INR rs crore", "Rent": None, "Fees in USD actual": "USD absolute"}
    assert dict(zip(cases, apply(spark, cases, units.row_unit, F.lit("INR Lakh")))) == cases


@pytest.mark.parametrize("value,currency,target,shown", [
    (316e6, "INR", "auto", "₹31.60 Cr"), (150_000.0, "INR", "auto", "₹1.50 L"), (99_999.0, "INR", "auto", "₹99,999"), (5e6, "INR", "lakh", "₹50.00 L"), (5e6, "INR", "crore", "₹0.50 Cr"),
    (2.5e6, "USD", "auto", "$2.50M"), (2500.0, "USD", "auto", "$2.50K"), (25.0, "USD", "auto", "$25"), (1234.5, "EUR", "auto", "1,234.50"), (-2e7, "INR", "auto", "₹-2.00 Cr"), (1234.5, "INR", "absolute", "1,234.50"),
])
def test_display(spark, value, currency, target, shown):
    assert spark.range(1).select(units.display(F.lit(value), F.lit(currency), target)).first()[0] == shown


def test_numbers(spark):
    cases = {"1,234.50": 1234.5, "(8.20)": -8.2, "-": None, "—": None, "N/A": None, "na": None, "": None, " 12 ": 12.0, "67.0% (calc)": None, "approx 22%": None, "1d": None, "nan": None, "inf": None, "1e3": 1000.0, "-5": -5.0, None: None}
    assert dict(zip(cases, apply(spark, cases, text.parse_number))) == cases


def test_headers(spark):
    extra = {"ARR ($000s)": "arr", "Gross Revenue (INR)": "revenue_gross", "Total Debtor": "accounts_receivable", "Closing Stock": "inventory", "Opening Stock": None, "EBITDA Margin %": "ebitda_margin_pct", "Random thing": None, "PAT Margin %": "pat_margin_pct"}
    names = {a.upper(): m for a, m in ALIASES.items()} | extra
    rows = spark.createDataFrame([(n,) for n in names], "h string")
    got = {r.h: r.metric for r in aliases.resolve_headers(rows, "h").collect()}
    assert got == names
    compat = {r.h: r.metric for r in aliases.resolve_headers(rows.where("h like '%Margin %' or h like '%Stock'"), "h", compat=True).collect()}
    assert compat == {"EBITDA Margin %": "gross_margin_pct", "PAT Margin %": "gross_margin_pct", "Closing Stock": "inventory", "Opening Stock": "inventory"}


def test_session_aliases(spark):
    aliases.register_alias(" Weird Header ", "cogs")
    try:
        rows = spark.createDataFrame([("weird header",)], "h string")
        assert aliases.resolve_headers(rows, "h").first().metric == "cogs"
    finally:
        aliases.clear_aliases()
    assert aliases.resolve_headers(spark.createDataFrame([("weird header",)], "h string"), "h").first().metric is None


def test_registry_counts():
    assert len(METRICS) == 35 and len(ALIASES) == 189 and sum(m.unit == "currency" for m in METRICS) == 26


def test_references_and_slugs(spark):
    got = spark.createDataFrame([(c,) for c in (1, 26, 27, 52, 702, 703, 728)], "c int").orderBy("c").select(text.cell_reference(F.col("c"), F.lit(7))).collect()
    assert [r[0] for r in got] == ["A7", "Z7", "AA7", "AZ7", "ZZ7", "AAA7", "AAZ7"]
    assert apply(spark, [" Meadow Foods Pvt. Ltd "], text.slugify) == ["meadow_foods_pvt_ltd"]


def test_claims(spark):
    cases = {"Rs. 45 lakh": True, "INR 12 crore": True, "FY2024A": True, "Q1'22": True, "31.03.24": True, "45.2%": True, "3.2x": True, "plain prose": False, "id 1234567": False}
    assert dict(zip(cases, apply(spark, cases, text.has_claim))) == cases
    assert apply(spark, ["id 1234567, 99"], text.claim_values, "bare_large_number") == [["1234567"]]


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 99), st.integers(1, 12), st.integers(1, 4))
def test_period_round_trip(spark, y, m, q):
    p = [f"FY{y:02d}", f"FY{y:02d}-M{m:02d}", f"FY{y:02d}-Q{q}"]
    assert apply(spark, p, periods.parse_period) == p
