"""A landing folder as a stream: files are ingested as they arrive, each checksum once, with the plans of the batch path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import Engine
from ..sources import sheets


def watch(spark: SparkSession, folder: str, engine: Engine, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Start the stream. Each batch is one load, known by the checkpoint and the batch's number: one that failed midway has left nothing and is done again, one that was committed is not. Files of other kinds are not opened."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", sheets.glob()).load(folder)

    def load(batch: DataFrame, batch_id: int) -> None:
        engine.load(sheets.described(batch), f"{checkpoint}#{batch_id}")

    stream = files.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def event_rates(events: DataFrame, *, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and values by type in windows of event time; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
