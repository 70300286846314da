"""The query tools. Each asks live facts by parameters, returns exact numbers with citations, or raises a typed error."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Context, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import local_rows
from ..functions.units import display
from .derive import wide

#: Figures are computed with so many digits, whatever the caller's own context is.
EXACT = Context(prec=28)


class ToolError(Exception):
    """What a tool cannot answer."""


class MetricNotFound(ToolError):
    pass


class EntityNotFound(ToolError):
    pass


class PeriodNotFound(ToolError):
    pass


class AmbiguousEntity(ToolError):
    pass


class DivisionByZero(ToolError):
    pass


class UnitMismatch(ToolError):
    """Figures in units that cannot be compared."""


def one_unit(*rows) -> None:
    """Raises UnitMismatch for facts in different currencies, or a percentage beside an amount; a fact without a unit fits any."""
    units = sorted({r["currency"] for r in rows if r["currency"] not in (None, "", "UNKNOWN")})
    if len(units) > 1:
        raise UnitMismatch(f"cannot compare {' with '.join(units)}")


def _exact(value) -> Decimal:
    """A stored value as it is, written with at least one place after the point."""
    plain = f"{value if isinstance(value, Decimal) else Decimal(str(value)):f}"
    whole, _, places = plain.partition(".")
    return Decimal(f"{whole}.{places.rstrip('0') or '0'}")


class Tools:
    """Tools over live facts, files, entities and chunks (DataFrames). encoder: texts to vectors like those of the chunks; with it context is searched by meaning."""

    def __init__(self, live: DataFrame, files: DataFrame, entities: DataFrame, chunks: DataFrame | None = None, encoder: Callable | None = None, *, compat: bool = False, staging: DataFrame | None = None, conflicts: DataFrame | None = None) -> None:
        self.live, self.files, self.entities, self.chunks, self.encoder, self.compat, self.staging, self.conflicts = live, files, entities, chunks, encoder, compat, staging, conflicts

    def entity(self, entity: int | str) -> int:
        if isinstance(entity, int):
            found = self.entities.where(F.col("entity_id") == entity).select("entity_id").limit(1).collect()
        else:
            found = find_entities(self.entities, entity).select("entity_id").limit(2).collect()
        if not found:
            raise EntityNotFound(f"no entity {entity!r}")
        if len(found) > 1:
            raise AmbiguousEntity(f"more than one entity for {entity!r}")
        return found[0]["entity_id"]

    def _facts(self, entity: int, metric: str, periods: list[str]) -> dict:
        mine = self.live.where(F.col("entity_id") == entity)
        found = {r["period"]: r for r in facts_of(mine, metric, periods).collect()}
        mine = mine.where(F.col("canonical_field") == metric)
        for p in periods:
            if p not in found:
                known = [r["period"] for r in mine.select("period").distinct().orderBy("period").collect()]
                if not known:
                    raise MetricNotFound(f"no metric {metric} for entity {entity}")
                raise PeriodNotFound(f"no {metric} for {p}; there are {', '.join(known)}")
        return found

    @staticmethod
    def _citation(row) -> dict:
        r = row.asDict()
        return {k: r.get(k) for k in ("source_file_id", "source_sheet", "cell_reference", "fact_id")}

    def _shown(self, value: Decimal, currency: str, unit: str) -> str:
        return local_rows(self.live.sparkSession, [float(value)]).select(display(F.col("value"), F.lit(currency), unit)).first()[0]

    def fetch_metric(self, entity, metric: str, period: str, unit_out: str | None = None) -> dict:
        entity = self.entity(entity)
        r = self._facts(entity, metric, [period])[period]
        value = _exact(r["value_normalised"])
        out = {"entity_id": entity, "metric": metric, "period": period, "value": str(value), "currency": r["currency"], "citation": self._citation(r)}
        return out | ({"display": self._shown(value, r["currency"], unit_out)} if unit_out else {})

    def calculate_variance(self, entity, metric: str, period_1: str, period_2: str, unit_out: str | None = None) -> dict:
        entity = self.entity(entity)
        rows = self._facts(entity, metric, [period_1, period_2])
        one_unit(*rows.values())
        a, b = (_exact(rows[p]["value_normalised"]) for p in (period_1, period_2))
        out = {
            "entity_id": entity, "metric": metric, "period_1": period_1, "period_2": period_2, "value_1": str(a), "value_2": str(b), "delta": str(EXACT.subtract(b, a)),
            "delta_pct": str(EXACT.multiply(EXACT.divide(EXACT.subtract(b, a), a), 100)) if a else None, "citations": [self._citation(rows[p]) for p in (period_1, period_2)],
        }
        return out | ({"display_delta": self._shown(b - a, rows[period_2]["currency"], unit_out)} if unit_out else {})

    def calculate_ratio(self, entity, numerator: str, denominator: str, period: str, unit_out: str | None = None) -> dict:
        entity = self.entity(entity)
        n, d = (self._facts(entity, m, [period])[period] for m in (numerator, denominator))
        one_unit(n, d)
        a, b = _exact(n["value_normalised"]), _exact(d["value_normalised"])
        if not b:
            raise DivisionByZero(f"{denominator} is zero in {period}")
        return {
            "entity_id": entity, "numerator": numerator, "denominator": denominator, "period": period, "ratio": str(EXACT.divide(a, b)), "ratio_pct": str(EXACT.multiply(EXACT.divide(a, b), 100)),
            "citations": [self._citation(n), self._citation(d)], "display_hint": unit_out or "ratio",
        }

    def list_sources(self, entity, metric: str, period: str) -> dict:
        entity = self.entity(entity)
        rows = sources(self.live, self.files).where((F.col("entity_id") == entity) & (F.col("canonical_field") == metric) & (F.col("period") == period)).collect()
        if not rows:
            raise MetricNotFound(f"no {metric} for {period}")
        return {"entity_id": entity, "metric": metric, "period": period, "sources": [r.asDict() for r in rows]}

    def cite(self, entity, metric: str, period: str) -> dict:
        """All cells behind a figure, with the full citation of each: see lineage.envelopes."""
        from .lineage import envelopes

        entity = self.entity(entity)
        r = self._facts(entity, metric, [period])[period]
        if self.staging is None:
            raise ToolError("no staged facts to cite")
        mine = lambda df: df.where(F.col("entity_id") == entity)
        found = envelopes(mine(self.live).where(F.col("period") == period), mine(self.staging), self.files, None if self.conflicts is None else mine(self.conflicts))
        rows = found.where(F.col("fact_id") == r["fact_id"]).orderBy("depth", "leaf_id").collect()
        return {"entity_id": entity, "metric": metric, "period": period, "value": str(_exact(r["value_normalised"])), "citations": [x.asDict() for x in rows]}

    def list_available_metrics(self, entity) -> dict:
        entity = self.entity(entity)
        rows = available_metrics(self.live.where(F.col("entity_id") == entity)).orderBy("metric").collect()
        return {"entity_id": entity, "metrics": [{"metric": r["metric"], "observations": r["observations"]} for r in rows]}

    def search_context(self, entity, query: str, period_filter: str | None = None, metric_filter: str | None = None, vector: list[float] | None = None) -> dict:
        """Chunks that fit a question: the nearest of each file if there is a vector, or an encoder to make one; else those that hold most of its words."""
        from .text import keyword_search, vector_search

        entity = self.entity(entity)
        if self.chunks is None:
            return {"chunks": [], "search_mode": "none"}
        rows = self.chunks.where(F.col("entity_id") == entity)
        for column, wanted in (("linked_periods", period_filter), ("linked_metrics", metric_filter)):
            if wanted:
                rows = rows.where(linked(F.col(column), wanted, part=self.compat))
        if vector is None and self.encoder and "embedding" in rows.columns:
            vector = [float(x) for x in self.encoder([query])[0]]
        if vector is not None:
            found = vector_search(rows.where("embedding IS NOT NULL"), vector).orderBy("file_id", "place")  # at most 8 of each of an entity's files
        else:
            found = keyword_search(rows, query)
        return {"chunks": [r.asDict() for r in self._shown_chunks(found).collect()], "search_mode": "keyword" if vector is None else "similarity"}

    def chunks_by_id(self, ids: list[int]) -> list[dict]:
        """The chunks with these ids, in order of id."""
        return [r.asDict() for r in self._shown_chunks(by_ids(self.chunks, "chunk_id", ids).orderBy("chunk_id")).collect()] if self.chunks is not None else []

    @staticmethod
    def _shown_chunks(rows: DataFrame) -> DataFrame:
        return rows.select("chunk_id", "section_path", "contains_numerical_claim", F.substring("raw_text", 1, 600).alias("text"), "linked_fact_ids", "file_id")


# ---- the same over whole tables


def find_entities(entities: DataFrame, name: str) -> DataFrame:
    q = name.lower()
    return entities.where(F.lower("entity_name").contains(q) | F.col("entity_slug").contains(q.replace(" ", "_")))


def facts_of(live: DataFrame, metric: str, periods: list[str]) -> DataFrame:
    """Live facts of a metric in some periods."""
    return live.where((F.col("canonical_field") == metric) & F.col("period").isin(*periods))


def by_ids(rows: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """The rows with these ids: of a list that a caller holds, so a filter, not a join."""
    return rows.where(F.col(key).isin(*ids)) if ids else rows.limit(0)


def linked(column: Column, wanted: str, *, part: bool = False) -> Column:
    """Whether a list of names holds the wanted one, whatever its case; part: or one that the wanted one is part of."""
    low = wanted.lower()
    return F.exists(column, lambda x: F.lower(x).contains(low) if part else F.lower(x) == low)


def sources(live: DataFrame, files: DataFrame) -> DataFrame:
    """Each live fact with the file it comes from."""
    about = files.select("file_id", *[c for c in ("filename", "file_path") if c in files.columns])
    key = live["source_file_id"] == about["file_id"] if "source_file_id" in live.columns else "file_id"
    return live.join(F.broadcast(about) if about.limit(100_001).count() <= 100_000 else about, key)


def available_metrics(live: DataFrame, *by: str) -> DataFrame:
    """Metrics with how many facts there are of each, by some columns if wanted."""
    return live.groupBy(*by, F.col("canonical_field").alias("metric")).agg(F.count("*").alias("observations"))


def variances(live: DataFrame) -> DataFrame:
    """Each value against that of the fiscal year before: delta and delta_pct (null after zero)."""
    before = Window.partitionBy("entity_id", "canonical_field").orderBy("fiscal_year")
    rows = live.withColumn("last", F.lag("value_normalised").over(before)).withColumn("last_year", F.lag("fiscal_year").over(before))
    rows = rows.where(F.col("last_year") == F.col("fiscal_year") - 1)
    delta = F.col("value_normalised") - F.col("last")
    pct = F.when(F.col("last") != 0, F.round(delta.cast("decimal(24,6)") * 100 / F.col("last").cast("decimal(24,6)"), 4))
    return rows.select("entity_id", "canonical_field", "period", F.col("last").alias("value_1"), F.col("value_normalised").alias("value_2"), delta.alias("delta"), pct.alias("delta_pct"))


def ratios(live: DataFrame, numerator: str, denominator: str) -> DataFrame:
    t = wide(live, [numerator, denominator]).where(f"{numerator} IS NOT NULL AND {denominator} <> 0")
    return t.select("entity_id", "period", F.round(F.col(numerator).cast("decimal(24,6)") / F.col(denominator).cast("decimal(24,6)"), 4).alias("ratio"))
