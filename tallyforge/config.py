"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class EngineConf:
    """compat: True reproduces known quirks of older engines for this fact model; False is the documented behaviour."""

    compat: bool = False
    shuffle_partitions: int | None = None


def session(conf: EngineConf = EngineConf(), **settings: str) -> SparkSession:
    """A session with the settings that the plans here count on; a cluster's own settings win."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    if conf.shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(conf.shuffle_partitions))
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
