"""Algebra of canonical periods: each is an interval of months, so periods have an order, a distance, a grain, and parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Years of two digits from this one on are of the last century.
PIVOT = 70
#: Months of a grain.
MONTHS = {"year": 12, "quarter": 3, "month": 1}

_FISCAL = r"^FY(\d{2})(?:-([QM])(\d{1,2}))?$"


def first_month(period: Column) -> Column:
    """The first month of a period, counted from year 0; a fiscal year begins in April of the year before the one it is named for. Null for what is no period."""
    yy = F.regexp_extract(period, _FISCAL, 1).try_cast("int")
    april = (yy + F.when(yy >= PIVOT, 1900).otherwise(2000) - 1) * 12 + 3
    nth = F.coalesce(F.regexp_extract(period, _FISCAL, 3).try_cast("int"), F.lit(1)) - 1
    fiscal = april + nth * F.when(F.regexp_extract(period, _FISCAL, 2) == "Q", 3).otherwise(1)
    calendar = F.regexp_extract(period, r"^CY(\d{4})$", 1).try_cast("int") * 12
    return F.when(months(period).isNotNull(), F.coalesce(fiscal, calendar))


def months(period: Column) -> Column:
    """How many months a period has."""
    return F.when(period.rlike(r"^FY\d{2}$|^CY\d{4}$"), 12).when(period.rlike(r"^FY\d{2}-Q[1-4]$"), 3).when(period.rlike(r"^FY\d{2}-M(0?[1-9]|1[0-2])$"), 1)


def calendar(period: Column) -> Column:
    """What periods have to have in common to follow each other: their kind of year, and their months."""
    return F.concat(F.substring(period, 1, 2), months(period).cast("string"))


def contains(outer: Column, inner: Column) -> Column:
    """Whether a period lies within another, or is the same."""
    return (first_month(outer) <= first_month(inner)) & (first_month(outer) + months(outer) >= first_month(inner) + months(inner))


def distance(a: Column, b: Column) -> Column:
    """How many of their own lengths the second period begins after the first; null if they differ in kind, or do not lie on one grid."""
    apart = first_month(b) - first_month(a)
    return F.when((calendar(a) == calendar(b)) & (F.pmod(apart, months(a)) == 0), F.floor(apart / months(a)).cast("int"))
