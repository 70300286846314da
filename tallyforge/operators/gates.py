"""What a person decides before facts go live: counts to look at, and policies that answer in their place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A policy gets the text to be acknowledged and says yes or no.
Policy = Callable[[str], bool]


def accept(_: str) -> bool:
    return True


def ask(read: Callable[[str], str] = input) -> Policy:
    """A policy that asks a person: n or no refuses, as does an interrupt; anything else, or no terminal, accepts."""

    def policy(text: str) -> bool:
        try:
            return read(f"{text}\nGo live? [Y/n] ").strip().lower() not in ("n", "no")
        except EOFError:
            return True
        except KeyboardInterrupt:
            return False

    return policy


def counts(staging: DataFrame, files: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Facts, metrics and periods by file, with the file's unit and state: one pass over staging."""
    by_file = staging.groupBy("file_id").agg(F.count("*").alias("facts"), F.count_distinct("canonical_field").alias("metrics"), F.count_distinct("period").alias("periods"))
    open_ = conflicts.groupBy("entity_id").agg(F.count_if(F.col("state") == "OPEN").alias("open_conflicts"))
    joined = files.join(by_file, "file_id", "left").join(open_, "entity_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("file_id", "entity_id", "filename", "detected_unit", "state", zero("facts"), zero("metrics"), zero("periods"), zero("open_conflicts"))


def entity_overview(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Every entity (entity_id and what else is there) with how many files it has, and how many of them are live."""
    by_entity = files.groupBy("entity_id").agg(F.count("*").alias("files"), F.count_if(F.col("state") == "LIVE").alias("live_files"))
    joined = entities.join(by_entity, "entity_id", "left")
    return joined.select(*entities.columns, F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("live_files", F.lit(0)).alias("live_files"))


def sample(staging: DataFrame, n: int = 10) -> DataFrame:
    """The first facts by metric and period: a top-k, not a sort."""
    return staging.orderBy("canonical_field", "period", "staging_id").limit(n)


def summary(staging: DataFrame, files: DataFrame, conflicts: DataFrame, shown: int = 8) -> str:
    lines = [f"{r['filename']} [{r['detected_unit'] or 'UNKNOWN'}] {r['state']}: {r['facts']} facts, {r['open_conflicts']} open conflicts" for r in counts(staging, files, conflicts).orderBy("file_id").collect()]
    total = staging.count()
    for r in sample(staging).collect()[:shown]:
        lines.append(f"  {r['canonical_field']} {r['period']} {r['value_normalised']} {r['currency']}")
    if total > shown:
        lines.append(f"  and {total - shown} more")
    return "\n".join(lines)


def onboard(staging: DataFrame, files: DataFrame, conflicts: DataFrame, policy: Policy = accept) -> bool:
    return policy is accept or policy(summary(staging, files, conflicts))


def proceed_despite(issues: DataFrame, policy: Policy = accept) -> bool:
    """A soft block: errors of validation are put to the policy; without errors nothing is asked."""
    if policy is accept:
        return True
    errors = issues.where("severity = 'error'").limit(1).count()
    return policy("Validation found errors.") if errors else True
