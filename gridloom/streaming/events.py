"""An extension: events as a stream of positions, in tumbling windows and sessions. Each function takes a batch or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stamped(events: DataFrame, late: str) -> DataFrame:
    df = events.withColumn("at", F.col("ts").cast("timestamp"))
    return df.withWatermark("at", late) if events.isStreaming else df


def _named(window: Column) -> list[Column]:
    return [F.unix_timestamp(window["start"]).alias("starts"), F.unix_timestamp(window["end"]).alias("ends")]


def hourly(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, starts, ends (seconds), n, total."""
    out = _stamped(events, late).groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select("event_type", *_named(F.col("w")), "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """user_id, starts, ends (seconds), n of runs of events with no gap as long as ``gap``."""
    out = _stamped(events, late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", *_named(F.col("w")), "n")
