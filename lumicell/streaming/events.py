"""Event-time aggregation, the same functions for batch frames and streams.

Events are (event_id, ts, user_id, event_type, value); on a stream give a
watermark first, so that state is dropped once its window is past it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def watermarked(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Event time needs a time zone: a ts without one is taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def _sums():
    return [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]


def tumbling(events: DataFrame, width: str, *keys: str) -> DataFrame:
    out = events.groupBy(F.window("ts", width).alias("w"), *keys).agg(*_sums())
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, step: str, *keys: str) -> DataFrame:
    out = events.groupBy(F.window("ts", width, step).alias("w"), *keys).agg(*_sums())
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, *keys: str) -> DataFrame:
    """Runs of a key's events with less than `gap` between neighbours."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(*_sums())
    return out.select(F.col("w.start").alias("start"), *keys, "n", "total")


def first_of_each(events: DataFrame, *keys: str) -> DataFrame:
    """One event per key; on a stream, within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys)) if events.isStreaming else events.dropDuplicates(list(keys))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is there, append to Parquet and give it back."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
