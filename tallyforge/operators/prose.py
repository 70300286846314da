"""Figures in prose: a number with its hedge, currency and scale, and the metric and period of its clause that it speaks of.

A small grammar of typed parts is read off each clause: hedge, currency, amount, scale or percent sign. A number belongs
to the metric named last before it in its clause, else to the first after it; to the period nearest to it in the clause, else in the
sentence, else to the last one mentioned before. A percentage of a metric that is itself money says how it changed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import periods
from ..functions.names import Matcher, metric_names
from ..functions.text import fact_id
from ..registry import METRIC

# Words that hedge a number, in the three ways there are; currencies; scales; words for a fall.
HEDGES = {"about": ("approximately", "approx.", "approx", "about", "around", "nearly", "roughly", "circa", "c.", "~"), "at least": ("at least", "more than", "over", "above", "upwards of"), "at most": ("at most", "less than", "under", "below", "up to")}
CURRENCIES = {"INR": ("rs.", "rs", "inr", "₹", "rupees"), "USD": ("usd", "us$", "$")}
SCALES = {10_000_000: ("crores", "crore", "cr."), 100_000: ("lakhs", "lakh", "lacs", "lac"), 1_000_000_000: ("billion", "bn"), 1_000_000: ("million", "mn"), 1_000: ("thousand",)}
FALLS = r"\b(?:fell|fall|falls|declin\w+|decreas\w+|dropp?\w*|down|shr[aiu]nk|lower)\b"

_either = lambda words: "|".join(re.escape(w) + (r"(?!\w)" if w[-1].isalnum() else "") for w in sorted(words, key=len, reverse=True))
_every = lambda table: [w for words in table.values() for w in words]
NUMBER = re.compile(
    rf"(?:(?<!\w)(?P<hedge>{_either(_every(HEDGES))})\s*)?(?:(?<!\w)(?P<currency>{_either(_every(CURRENCIES))})\s*|(?<![\w.,]))(?P<sign>-)?(?<!\w)(?P<amount>\d[\d,]*(?:\.\d+)?)"
    rf"(?:\s*(?P<percent>%|per\s?cent(?!\w))|\s*(?P<scale>{_either(_every(SCALES))}))?(?!\w)(?:\s+(?P<after>{_either(('rupees', 'usd', 'inr'))}))?",
    re.I,
)
SENTENCE = re.compile(r"(?:[^.!?;\n]|(?<=\b[Rr]s)\.|(?<=\bapprox)\.|(?<=\bcr)\.|(?<=\bc)\.(?=\s?\d)|\.(?=\d))+")
CLAUSE = re.compile(r",\s+(?=while|whereas|and|but)|\s+(?=(?:while|whereas|but)\s)")

COLUMNS = "start int, end int, span string, hedge string, amount decimal(28,6), kind string, currency string, scale long, metric string, period_text string"

_matcher: list[Matcher] = []


def _of(table: dict, word: str | None):
    return next((k for k, words in table.items() if word and word.lower() in words), None)


def _nearest(spans: list[tuple[int, int, object]], start: int, end: int):
    return min(spans, key=lambda s: (max(s[0] - end, start - s[1]), s[0]), default=None)


def figures(text: str) -> list[tuple]:
    """COLUMNS of each figure that belongs to a metric. amount is as written, with its sign; kind: value, percent (of a metric that is one), or change."""
    if not _matcher:
        _matcher.append(Matcher(metric_names()))
    named, dated = _matcher[0].find(text), [(s, e, text[s:e]) for s, e in periods.mentions(text)]
    dated = [d for k, d in enumerate(dated) if not any(o[0] <= d[0] and d[1] <= o[1] and o != d for o in dated[:k])]
    out, last = [], None
    for sentence in SENTENCE.finditer(text):
        cuts = [sentence.start(), *(m.end() + sentence.start() for m in CLAUSE.finditer(sentence[0])), sentence.end()]
        within = lambda spans, a, b: [s for s in spans if a <= s[0] and s[1] <= b]
        for a, b in zip(cuts, cuts[1:]):
            metrics, when = within(named, a, b), within(dated, a, b)
            for m in NUMBER.finditer(text, a, b):
                if any(s < m.end("amount") and m.start("amount") < e for s, e, _ in [*dated, *metrics]):
                    continue
                before = [s for s in metrics if s[1] <= m.start()]
                metric = (before[-1] if before else metrics[0])[2] if metrics else None
                if metric is None:
                    continue
                period = _nearest(when, m.start(), m.end()) or _nearest(within(dated, cuts[0], cuts[-1]), m.start(), m.end()) or last
                amount = Decimal(m["amount"].replace(",", "").rstrip("."))
                if len(m["amount"].partition(".")[0].replace(",", "")) > 22:
                    continue
                amount = amount.quantize(Decimal("0.000001"))
                unit = METRIC[metric].unit
                kind = "value" if not m["percent"] else "percent" if unit == "percentage" else "change"
                fell = kind == "change" and re.search(FALLS, text[a : m.start()], re.I)
                currency = _of(CURRENCIES, m["currency"] or m["after"])
                out.append((m.start(), m.end(), m[0], _of(HEDGES, m["hedge"]), -amount if bool(m["sign"]) != bool(fell) else amount, kind, currency, _of(SCALES, m["scale"]) or 1, metric, period[2] if period else None))
        last = (within(dated, cuts[0], cuts[-1]) or [last])[-1]
    return out


def extract(docs: DataFrame, *, text: str = "raw_text", keep: list[str] | None = None) -> DataFrame:
    """One row for each figure in the texts: the kept columns, its place (code points, the end exclusive) and span, hedge (about, at least, at most, or null), metric, canonical period (null if none is near), kind
    (value, percent, change), value in base units (percentages and changes in percent), currency, original_unit and conversion_factor.

    Defined results: null and empty texts, and numbers without a metric in their clause, give nothing; periods and digits within names are no figures;
    numbers of more than 22 digits before the point are left out; a text repeated gives its figures again; a text is read as a whole, whatever its length.
    """
    kept = docs.columns if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text"))
    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.decimal128(28, 6), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in COLUMNS.replace("(28,6)", "").split(", ")]
        for batch in batches:
            found = [(i, f) for i, t in enumerate(batch.column(len(kept)).to_pylist()) if t for f in figures(t)]
            at = pa.array([i for i, _ in found], pa.int64())
            columns = [pa.array([f[k] for _, f in found], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(len(kept))), *columns], [*(f"k{i}" for i in range(len(kept))), *names])

    found = rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}{COLUMNS}")
    # each notation is read once for each text that dates
    plain = F.col("kind") != "value"
    factor = F.when(plain, 1).otherwise(F.col("scale"))
    money = F.col("metric").isin([m.name for m in METRIC.values() if m.unit == "currency"]) & ~plain
    currency = F.when(plain, "PERCENTAGE").when(money, F.coalesce("currency", F.lit("INR"))).otherwise(F.col("currency"))
    words = F.create_map(*[F.lit(x) for k, w in SCALES.items() for x in (k, w[min(1, len(w) - 1)].title())])
    return found.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "start", "end", "span", "hedge", "metric", periods.parse_period(F.col("period_text")).alias("period"), "kind",
        (F.col("amount") * factor.cast("decimal(10,0)")).cast("decimal(28,6)").alias("value"), currency.alias("currency"),
        F.when(plain, "%").otherwise(F.concat_ws(" ", currency, F.element_at(words, F.col("scale").cast("int")))).alias("original_unit"), factor.cast("double").alias("conversion_factor"),
    )


def as_facts(figures: DataFrame, entities: DataFrame) -> DataFrame:
    """Figures (of chunks: entity_id, chunk_id, file_id) as facts of narrative sources: values and percentages with a period; changes are left to comparisons, hedged values keep their hedge as a note."""
    rows = figures.where("kind <> 'change' AND period IS NOT NULL").join(entities.select("entity_id", "entity_slug"), "entity_id")
    return rows.select(
        fact_id(F.col("entity_slug"), F.col("period"), F.col("metric")).alias("fact_id"), "entity_id", "entity_slug", F.col("metric").alias("canonical_field"), "period",
        F.col("value").alias("value_normalised"), "currency", "original_unit", "conversion_factor", F.col("file_id").alias("source_file_id"),
        F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"), F.lit(":"), "start", F.lit("-"), "end").alias("cell_reference"), F.col("span").alias("authoritative_note"), "hedge",
    )
