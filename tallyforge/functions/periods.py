"""Fiscal periods as Column expressions. A fiscal year runs from April to March and has the name of the year it ends in."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MON = f"({'|'.join(MONTHS)})[a-z]*"


def _year(digits: Column) -> Column:
    y = digits.cast("int")
    return F.when(y < 100, y + 2000).otherwise(y)


def _fy(year: Column) -> Column:
    return F.concat(F.lit("FY"), F.substring(year.cast("string"), 3, 4))


def _two(n: Column) -> Column:
    return F.lpad(n.cast("int").cast("string"), 2, "0")


def _month(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)).cast("int")


def fiscal_year(year: Column, month: Column) -> Column:
    """The fiscal year of a calendar month."""
    return year + (month >= 4).cast("int")


def _quarter(y: Column, q: Column) -> Column:
    return F.concat(_fy(_year(y)), F.lit("-Q"), q.cast("int").cast("string"))


def _dated(y: Column, m: Column) -> Column:
    return _fy(fiscal_year(_year(y), m))


# The notations of a period, in order, and what a text in each of them is.
NOTATIONS = [
    (r"FY\s*(\d{2,4})", lambda y: _fy(_year(y))),
    (r"FY\s*(\d{2,4})[_-]M(\d{1,2})", lambda y, m: F.concat(_fy(_year(y)), F.lit("-M"), _two(m))),
    (r"FY\s*(\d{2,4})[_-]?Q(\d)", _quarter),
    (r"Q(\d)\s*FY\s*(\d{2,4})", lambda q, y: _quarter(y, q)),
    (_MON + r"[\s-](\d{2,4})", lambda m, y: F.concat(_dated(y, _month(m)), F.lit("-M"), _two(F.pmod(_month(m) + 8, F.lit(12)) + 1))),
    (r"FY\s*(\d{4})\s*[-–]\s*(\d{2,4})", lambda _, y: _fy(F.when(F.length(y) == 4, y.cast("int")).otherwise(y.cast("int") + 2000))),
    (r"FY\s*(\d{2,4})[AEP]", lambda y: _fy(_year(y))),
    (r"Q([1-4])['’](\d{2,4})", lambda q, y: _quarter(y, q)),
    (r"(\d{1,2})[\s-]" + _MON + r"[\s-](\d{2,4})", lambda _, m, y: _dated(y, _month(m))),
    (r"(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})", lambda _, m, y: _dated(y, m.cast("int"))),
    (r"CY\s*(\d{4})", lambda y: F.concat(F.lit("CY"), y)),
    (r"(20\d{2})", lambda y: F.concat(F.lit("CY"), y)),
]


def _rules(s: Column) -> list[tuple[str, Column]]:
    out = []
    for pattern, build in NOTATIONS:
        whole = f"(?i)^{pattern}$"
        out.append((whole, build(*(F.regexp_extract(s, whole, k) for k in range(1, re.compile(pattern).groups + 1)))))
    return out


def mentions(text: str) -> list[tuple[int, int]]:
    """Where a text has a period in one of the notations: the longest at each place, by place."""
    longest: dict[int, int] = {}
    for pattern, _ in NOTATIONS:
        for m in re.finditer(pattern, text, re.I):
            longest[m.start()] = max(m.end(), longest.get(m.start(), 0))
    return sorted(longest.items())


def mentioned(text: Column) -> Column:
    """Whether a text has a period in one of the notations."""
    return text.rlike("(?i)" + "|".join(pattern for pattern, _ in NOTATIONS))


def parse_period(raw: Column) -> Column:
    """Canonical period of a text, or null. Of a range only the end counts: what follows its last "to"."""
    s = F.trim(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    ranged = "(?i)^.+\\s+to\\s+(.+)$"
    # no other rule fits a text with " to " in it
    s = F.when(s.rlike(ranged), F.trim(F.regexp_extract(s, ranged, 1))).otherwise(s)
    rules = _rules(s)
    out = F.lit(None).cast("string")
    for pattern, value in reversed(rules):
        out = F.when(s.rlike(pattern), value).otherwise(out)
    return out


def period_of(date: Column, grain: str = "year") -> Column:
    """Canonical fiscal period of a date: FYyy, or FYyy-Mmm by month, FYyy-Qq by quarter."""
    nth = F.pmod(F.month(date) + 8, F.lit(12)) + 1
    year = _fy(fiscal_year(F.year(date), F.month(date)))
    if grain == "month":
        return F.concat(year, F.lit("-M"), _two(nth))
    if grain == "quarter":
        return F.concat(year, F.lit("-Q"), F.ceil(nth / 3).cast("string"))
    return year


def period_label(period: Column) -> Column:
    """A period for readers: FY24 (Apr 2023–Mar 2024), Sep 2023, Q2 FY24 (Jul–Sep); otherwise as it is."""
    year = _year(F.regexp_extract(period, r"^FY(\d{2})", 1))
    nth = F.regexp_extract(period, r"-[MQ](\d{1,2})$", 1).cast("int")
    month = F.pmod(nth + 2, F.lit(12)) + 1
    names = F.array(*(F.lit(m.title()) for m in MONTHS))
    spans = F.array(*map(F.lit, ("Apr–Jun", "Jul–Sep", "Oct–Dec", "Jan–Mar")))
    return (
        F.when(period.rlike(r"^FY\d{2}$"), F.concat(period, F.lit(" (Apr "), year - 1, F.lit("–Mar "), year, F.lit(")")))
        .when(period.rlike(r"^FY\d{2}-M(0[1-9]|1[0-2])$"), F.concat_ws(" ", F.element_at(names, month.cast("int")), year - (month > 3).cast("int")))
        .when(period.rlike(r"^FY\d{2}-Q[1-4]$"), F.concat(F.lit("Q"), nth, F.lit(" "), F.substring(period, 1, 4), F.lit(" ("), F.element_at(spans, nth), F.lit(")")))
        .otherwise(period)
    )
