"""Conflicts as facts arrive: a stream that remembers the range of values of each figure and says when a new one disagrees."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.agreement import band
from ..operators.reconcile import KEY

#: How long after its latest fact a figure is remembered, in event time.
KEEP_MS = 30 * 24 * 3600 * 1000
OUT = "entity_id int, canonical_field string, period string, low decimal(28,6), high decimal(28,6), low_id long, high_id long, facts long"
STATE = "low decimal(28,6), high decimal(28,6), low_id long, high_id long, facts long"


def apart(low: Decimal, high: Decimal, share: float) -> bool:
    """Whether values disagree: their range exceeds the share of the larger."""
    return float(high - low) > share * float(max(abs(low), abs(high)))


def _widened(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One row if the values of the key disagree and their range, or what states its ends, has changed; that is all that is remembered."""
    if state.hasTimedOut:
        state.remove()
        return
    known = state.get if state.exists else None
    before = None if known is None else tuple(known)
    share, newest = 0.0, 0
    for rows in batches:
        for value, staging_id, s, seen in zip(rows["value_normalised"], rows["staging_id"], rows["share"], rows["seen_at"], strict=True):
            share, newest = float(s), max(newest, int(seen.timestamp() * 1000))
            value, staging_id = Decimal(value), int(staging_id)
            if known is None:
                known = (value, value, staging_id, staging_id, 1)
            else:
                low, high, low_id, high_id, n = known
                if (value, staging_id) < (low, low_id):
                    low, low_id = value, staging_id
                if (value, -staging_id) > (high, -high_id):
                    high, high_id = value, staging_id
                known = (low, high, low_id, high_id, n + 1)
    if known is None:
        return
    state.update(known)
    if newest + KEEP_MS > state.getCurrentWatermarkMs():
        state.setTimeoutTimestamp(newest + KEEP_MS)
    if (before is None or before[:4] != known[:4]) and apart(known[0], known[1], share):
        yield pd.DataFrame([(*key, *known)], columns=[c.split()[0] for c in OUT.split(", ")])


def conflicts(staged: DataFrame, *, late: str = "2 days") -> DataFrame:
    """A stream of staged facts (the key, value_normalised, staging_id, seen_at) as a stream of conflicts: the key, its lowest and highest value with the facts that state them, and how many facts there were.

    A row is given out whenever values of a key disagree by more than the metric's band and their range, or the facts that stand for its ends, have changed, so the last row of a key is what the
    batch finds, in whatever order facts come. Facts later than the watermark are left out; a figure without a new fact for KEEP_MS of event time is
    forgotten. Facts without a value are ignored; of equal values the smallest staging_id stands for all.
    """
    rows = staged.where("value_normalised IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", late)
    rows = rows.select(*KEY, F.col("value_normalised").cast("decimal(28,6)").alias("value_normalised"), F.col("staging_id").cast("long").alias("staging_id"), band(F.col("canonical_field")).alias("share"), "seen_at")
    return rows.groupBy(*KEY).applyInPandasWithState(_widened, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def ranges(staged: DataFrame) -> DataFrame:
    """The same of facts that are all there: the conflicts that the stream has named last."""
    rows = staged.where("value_normalised IS NOT NULL").withColumn("value_normalised", F.col("value_normalised").cast("decimal(28,6)"))
    low, high = F.struct("value_normalised", "staging_id"), F.struct("value_normalised", (-F.col("staging_id")).alias("k"))
    found = rows.groupBy(*KEY).agg(F.min(low).alias("a"), F.max(high).alias("b"), F.count("*").alias("facts"))
    found = found.select(*KEY, F.col("a.value_normalised").alias("low"), F.col("b.value_normalised").alias("high"), F.col("a.staging_id").alias("low_id"), (-F.col("b.k")).alias("high_id"), "facts")
    gap = (F.col("high") - F.col("low")).cast("double")
    return found.where(gap > band(F.col("canonical_field")) * F.greatest(F.abs("low"), F.abs("high")).cast("double"))
