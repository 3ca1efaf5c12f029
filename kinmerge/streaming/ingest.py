"""Pushed contact events as a stream: parsed, deduplicated under a watermark, folded into a state table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import identified


def read_events(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """(key, updated, payload, at) of the identify events in a folder of JSON lines; repeats inside the watermark go."""
    lines = spark.readStream.schema("value string").text(folder).select(F.col("value").alias("payload"))
    events = identified(lines).withColumn("at", F.try_to_timestamp("updated"))
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["key", "updated"])


def append_raw(events: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Raw events appended to a Parquet table, exactly once; upserts read it by key."""
    out = events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()


def latest(raw: DataFrame) -> DataFrame:
    """The newest payload of each key; of equal times the greater payload."""
    return raw.groupBy("key").agg(F.max(F.struct("updated", "payload")).alias("m")).select("key", "m.updated", "m.payload")
