"""Numbers, references, names and claims in texts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def local_rows(spark: SparkSession, values: list) -> DataFrame:
    """place and value of a few values, as a relation that is evaluated on the driver without a job."""
    rows = ", ".join(f"({i}, :v{i})" for i in range(len(values)))
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rows(place, value)", args={f"v{i}": v for i, v in enumerate(values)})


BLANK = ("", "-", "—", "n/a", "na")


def parse_number(raw: Column) -> Column:
    """A cell's number: commas and accounting parentheses are understood; blanks, words, nan and infinity give null."""
    s = F.trim(raw)
    signed = F.regexp_replace(F.regexp_replace(s, ",", ""), r"^\((.*)\)$", "-$1")
    number = F.trim(signed).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(F.lower(s).isin(*BLANK), None).when(number, F.trim(signed).try_cast("double"))


def cell_reference(column: Column, row: Column) -> Column:
    """A1 notation of a cell: column and row from 1; up to three letters."""
    c = column.cast("int") - 1
    letter = lambda n: F.char(n + 65)
    name = (
        F.when(c < 26, letter(c))
        .when(c < 26 + 676, F.concat(letter(F.floor((c - 26) / 26)), letter(F.pmod(c - 26, F.lit(26)))))
        .otherwise(F.concat(letter(F.floor((c - 702) / 676)), letter(F.pmod(F.floor((c - 702) / 26), F.lit(26))), letter(F.pmod(c - 702, F.lit(26)))))
    )
    return F.concat(name, row.cast("string"))


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_")


def fact_id(slug: Column, period: Column, metric: Column) -> Column:
    return F.concat_ws("_", F.lit("f"), slug, period, metric)


# What counts as a numerical claim, in the order in which claims are listed.
CLAIMS = {
    "currency": r"(?i)(?:Rs\.?\s*|INR\s*|\$\s*|USD\s*)?\d[\d,]*\.?\d*\s*(?:lakh|lakhs|crore|crores|million|billion|thousand|mn|bn|cr\.?)\b",
    "period": r"(?i)(?:FY\s*\d{2,4}|FY\s*\d{2,4}[-_]Q[1-4]|FY\s*\d{2,4}[-_]M\d{1,2}|CY\s*\d{4}|Q[1-4]\s*['’]?\d{2}|\d{1,2}[.-]\d{2}[.-]\d{2,4}|\d{1,2}[-\s](?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-\s]\d{2,4})",
    "percentage": r"\d+\.?\d*\s*%",
    "bare_large_number": r"\b\d{6,}\b",
    "multiplier": r"\d+\.?\d*\s*x\b",
}


def claim_values(text: Column, kind: str) -> Column:
    """All matches of a kind of claim."""
    return F.regexp_extract_all(text, F.lit(f"({CLAIMS[kind]})"), F.lit(1))


def has_claim(text: Column) -> Column:
    """Whether a text makes a numerical claim; a large number by itself is none."""
    found = [text.rlike(pattern) for kind, pattern in CLAIMS.items() if kind != "bare_large_number"]
    out = found[0]
    for f in found[1:]:
        out = out | f
    return out


def word_count(text: Column) -> Column:
    """Parts between white space; an empty text has one."""
    return F.size(F.split(F.trim(text), r"\s+"))


def sentences(text: Column) -> Column:
    """Stretches that end in . ! or ?; a tail without an end is matched as well, once and as a whole, and left out."""
    found = F.regexp_extract_all(text, F.lit(r"([^.!?]*+[.!?]++\s*+|[^.!?]++$)"), F.lit(1))
    return F.transform(F.filter(found, lambda t: t.rlike("[.!?]")), F.trim)
