"""Currency units: detection, normalisation and display, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a unit looks like, in order; the first that is found counts.
UNITS = [
    (r"rs\.?\s*crore|inr\s*cr|crore|cr\.", "INR", 10_000_000, "INR Crore"),
    (r"rs\.?\s*lakh|inr\s*lakh|lakh|lac\b", "INR", 100_000, "INR Lakh"),
    (r"rs\.?\s*thousand|inr\s*thousand|'000\s*inr", "INR", 1_000, "INR Thousand"),
    (r"rs\.?\s*million|inr\s*million", "INR", 1_000_000, "INR Million"),
    (r"inr\s*absolute|inr$|rs\.?$|rupees", "INR", 1, "INR"),
    (r"usd\s*thousand|usd\s*'?000|\$\s*thousand", "USD", 1_000, "USD Thousand"),
    (r"usd\s*million|usd\s*mn|\$\s*million|\$mn", "USD", 1_000_000, "USD Million"),
    (r"usd\s*billion|\$\s*billion|\$bn", "USD", 1_000_000_000, "USD Billion"),
    (r"usd$|\$\s*$|usd\s*absolute", "USD", 1, "USD"),
]
#: Units that a row's label can ask for; understood unless compat.
MORE_UNITS = [
    (r"\b(?:inr|rs\.?)\s*(?:cr|crores)\b", "INR", 10_000_000, "INR Crore"),
    (r"\b(?:inr|rs\.?)\s*lacs\b", "INR", 100_000, "INR Lakh"),
    (r"\b(?:inr|rs\.?)\s*mn\b", "INR", 1_000_000, "INR Million"),
    (r"\b(?:inr|rs\.?)\s*'?000s?\b", "INR", 1_000, "INR Thousand"),
    (r"\$\s*'?000s?\b", "USD", 1_000, "USD Thousand"),
]


def detect_unit(text: Column, compat: bool = True) -> Column:
    """struct(currency, multiplier, label) of a unit text; UNKNOWN with 1 where nothing is found."""
    s = F.trim(text)
    build = lambda c, m, n: F.struct(F.lit(c).alias("currency"), F.lit(m).cast("long").alias("multiplier"), F.lit(n).alias("label"))
    out = build("UNKNOWN", 1, "UNKNOWN")
    for pattern, currency, multiplier, label in reversed(UNITS if compat else UNITS + MORE_UNITS):
        out = F.when(s.rlike(f"(?i){pattern}"), build(currency, multiplier, label)).otherwise(out)
    return out


def normalise(value: Column, unit: Column, compat: bool = True) -> Column:
    """struct(value, currency, original_unit, factor, applied): a value in base units, exactly."""
    u = detect_unit(unit, compat)
    factor = u["multiplier"]
    return F.struct(
        (value.cast("decimal(24,6)") * factor.cast("decimal(10,0)")).cast("decimal(28,6)").alias("value"),
        u["currency"].alias("currency"), u["label"].alias("original_unit"), factor.alias("factor"), (factor != 1).alias("applied"),
    )


# What a row's label can ask for.
_ROW_UNIT = r"(?i)\b(?:(?:rs\.?|inr|usd)?\s*(?:crore|crores|cr\.?|lakh|lakhs|lacs|million|mn|thousand|000))\b"
_ABSOLUTE = r"(?i)\b(?:rs\.?|inr|usd)\s*(?:absolute|actual|exact|value|amount)\b"


def row_unit(label: Column, sheet_unit: Column) -> Column:
    """The unit that a row's label asks for, as unit text, or null: an absolute amount, a unit in parentheses, a unit anywhere, or rupees in a scaled sheet."""
    low = F.lower(label)
    inner = F.regexp_extract(F.regexp_extract(label, r"\(([^)]*)\)", 1), _ROW_UNIT, 0)
    anywhere = F.regexp_extract(label, _ROW_UNIT, 0)
    named = lambda t: F.concat(F.when(F.lower(t).contains("usd"), "USD ").otherwise("INR "), F.lower(t))
    absolute = lambda dollars: F.when(dollars, "USD absolute").otherwise("INR absolute")
    scaled = F.lower(sheet_unit).rlike("lakh|lac|crore|mn|million")
    return (
        F.when(label.rlike(_ABSOLUTE), absolute(low.contains("usd")))
        .when(inner != "", named(inner))
        .when(anywhere != "", named(anywhere))
        .when((low.contains("rupee") | low.rlike(r"\brs\b")) & scaled, absolute(F.lower(sheet_unit).contains("usd")))
    )


def display(value: Column, currency: Column, target: str = "auto") -> Column:
    """An amount for readers: crore and lakh, millions and thousands, or plain; rounding is half-even like the number format's. What is no finite number is shown as nan, inf or -inf."""
    v = value.cast("double")
    endless = F.when(F.isnan(v), "nan").when(v == float("inf"), "inf").when(v == float("-inf"), "-inf")
    grouped = lambda x, places: F.coalesce(endless, F.format_number(x, places))
    fixed = lambda x, unit: F.concat(F.regexp_replace(grouped(x, 2), ",", ""), F.lit(unit))
    plain = grouped(v, 2)
    crore, lakh = fixed(v / 10_000_000, " Cr"), fixed(v / 100_000, " L")
    if target == "crore":
        inr = crore
    elif target == "lakh":
        inr = lakh
    elif target == "auto":
        inr = F.when(F.abs(v) >= 10_000_000, crore).when(F.abs(v) >= 100_000, lakh).otherwise(grouped(v, 0))
    else:
        inr = None
    usd = F.when(F.abs(v) >= 1_000_000, fixed(v / 1_000_000, "M")).when(F.abs(v) >= 1_000, fixed(v / 1_000, "K")).otherwise(grouped(v, 0)) if target == "auto" else None
    out = plain
    if usd is not None:
        out = F.when(currency == "USD", F.concat(F.lit("$"), usd)).otherwise(out)
    if inr is not None:
        out = F.when(currency == "INR", F.concat(F.lit("₹"), inr)).otherwise(out)
    return out
