"""Headers to metrics: exact names first, then a score of shared keywords. Resolve distinct headers only, then join."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import ALIASES, MARGIN_ALIASES, METRICS, MODIFIERS, STOPWORDS

_session: dict[str, str] = {}


def register_alias(header: str, metric: str) -> None:
    """A name that a user, or an injected mapper, has given to a metric in this session."""
    _session[header.strip().lower()] = metric


def clear_aliases() -> None:
    _session.clear()


def known_aliases(compat: bool = False) -> dict[str, str]:
    return ALIASES | ({} if compat else MARGIN_ALIASES) | _session


def _tokens(header: Column, compat: bool) -> Column:
    plain = F.regexp_replace(F.lower(header), r"\(.*?\)", " ")
    words = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\b([a-z]+)\b"), F.lit(1)))
    dropped = set(STOPWORDS) | set(MODIFIERS) - (set() if compat else {"opening"})
    return F.array_except(words, F.array(*map(F.lit, sorted(dropped))))


def resolve_headers(headers: DataFrame, column: str, compat: bool = False) -> DataFrame:
    """column and metric for each distinct header; of scores, at least 2, or 1 for up to four words, is needed, and the earliest metric wins ties."""
    named = known_aliases(compat)
    table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    key = F.lower(F.trim(F.col(column)))
    bare = F.trim(F.regexp_replace(key, r"\s*\(.*?\)\s*", " "))
    rows = headers.select(column).distinct().where(F.col(column).isNotNull())
    exact = F.coalesce(F.element_at(table, key), F.when(bare != "", F.element_at(table, bare)))
    registry = F.array(
        *[
            F.struct(F.lit(i).alias("i"), F.lit(m.name).alias("name"), F.array(*map(F.lit, words)).alias("words"), F.array(*map(F.lit, [w for w in words if w in m.display.lower() or w in m.name])).cast("array<string>").alias("named"))
            for i, m in enumerate(METRICS)
            if (words := [k for k in m.keywords if re.fullmatch("[a-z]+", k)])
        ]
    )
    scored = rows.withColumn("__exact", exact).withColumn("__tokens", _tokens(F.col(column), compat))
    tokens = F.col("__tokens")

    def score(m: Column) -> Column:
        shared = F.array_intersect(tokens, m["words"])
        whole = F.when(F.size(F.array_except(tokens, m["words"])) == 0, 1.0).otherwise(0.0)
        return F.struct((F.size(shared) + whole + 0.5 * F.size(F.array_intersect(shared, m["named"]))).alias("score"), (-m["i"]).alias("first"), m["name"].alias("name"))

    best = F.array_max(F.transform(registry, score))
    scored = scored.withColumn("__best", F.when(F.col("__exact").isNull() & (F.size(tokens) > 0), best))
    accepted = (F.col("__best.score") >= 2) | ((F.col("__best.score") >= 1) & (F.size(tokens) <= 4))
    if not compat:  # an opening balance is not the closing one
        accepted &= ~F.array_contains(tokens, "opening")
    return scored.select(column, F.coalesce("__exact", F.when(accepted, F.col("__best.name"))).alias("metric"))
