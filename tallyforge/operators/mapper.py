"""Headers that no rule knows, mapped to metrics by an injected mapper, with a cache in the store.

The mapper gets a prompt and gives a text: a JSON list with an object for each header. What it says is checked against
the registry, kept by the MD5 of the header in lower case, and from then on the header is a name of its metric.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aliases import register_alias
from ..registry import METRIC, METRICS
from .router import response_text
from .store import Store

#: Headers that one prompt asks about.
ASKED = 50
#: How sure a mapper can be; what is less sure than the last of them is looked at by a person.
CONFIDENCE = ("high", "medium", "low")


def header_key(header: Column) -> Column:
    """What a header is cached by: the MD5 of its trimmed lower-case text."""
    return F.md5(F.lower(F.trim(header)))


def prompt(headers: list[str], about: dict[str, str] | None = None) -> str:
    """What a mapper is asked. about: what is known of the file (entity, file, sheet, unit, layout)."""
    lines = ["Match each header of a financial sheet with one metric of this list, or with null if none is clearly meant.", "", "Metrics:"]
    lines += [f"- {m.name}: {m.display} ({m.unit}); {', '.join(m.keywords)}" for m in METRICS]
    if about:
        lines += ["", "File:", *(f"- {k}: {v}" for k, v in about.items() if v)]
    lines += ["", "Answer with a JSON list alone, an object for each header, none left out:"]
    lines.append('{"raw_header": text, "canonical_field": metric or null, "confidence": "high" | "medium" | "low", "needs_review": true | false, "reasoning": text}')
    return "\n".join([*lines, "", "Headers:", json.dumps(headers, ensure_ascii=False)])


def parse(answer: str | dict, headers: list[str]) -> list[dict]:
    """The answer's mappings for the headers that were asked, each once; unknown metrics are null and to be reviewed; what is no JSON list is an error."""
    text = response_text(answer) if isinstance(answer, dict) else answer
    begin, end = text.find("["), text.rfind("]")
    if begin < 0 or end < begin:
        raise ValueError(f"no JSON list in {text[:200]!r}")
    said = {}
    for m in json.loads(text[begin : end + 1]):
        if isinstance(m, dict) and isinstance(m.get("raw_header"), str):
            said.setdefault(m["raw_header"].strip().lower(), m)
    out = []
    for h in headers:
        m = said.get(h.strip().lower(), {})
        field, sure = m.get("canonical_field"), m.get("confidence")
        known = isinstance(field, str) and field in METRIC
        sure = sure if sure in CONFIDENCE else "low"
        review = bool(m.get("needs_review")) or sure == "low" or (field is not None and not known)
        out.append({"raw_header": h, "canonical_field": field if known else None, "confidence": sure, "needs_review": review, "reasoning": str(m.get("reasoning") or "")})
    return out


def map_headers(store: Store, unmapped: DataFrame, ask: Callable[[str], str | dict], about: dict[str, str] | None = None) -> DataFrame:
    """header_cache rows of the distinct headers in unmapped (column named), asked from the mapper where the cache lacks them.

    Headers are few and short, whatever the sheets hold; they are asked in prompts of at most ASKED. Those that a metric
    was found for, with no need of a review, become aliases of the session.
    """
    wanted = unmapped.select(F.col("named").alias("raw_header")).distinct().withColumn("header_key", header_key(F.col("raw_header")))
    missing = sorted(r["raw_header"] for r in wanted.join(store.read("header_cache").select("header_key"), "header_key", "left_anti").collect())
    for at in range(0, len(missing), ASKED):
        part = missing[at : at + ASKED]
        rows = [(m["raw_header"], m["canonical_field"], m["confidence"], m["needs_review"], m["reasoning"]) for m in parse(ask(prompt(part, about)), part)]
        made = store.spark.createDataFrame(rows, "raw_header string, canonical_field string, confidence string, needs_review boolean, reasoning string")
        store.log("header_cache", made.withColumn("header_key", header_key(F.col("raw_header"))).withColumn("created_at", F.current_timestamp()))
    found = store.read("header_cache").join(wanted.select("header_key").distinct(), "header_key", "left_semi")
    for r in found.where("canonical_field IS NOT NULL AND NOT needs_review").collect():
        register_alias(r["raw_header"], r["canonical_field"])
    return found
