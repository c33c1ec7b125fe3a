"""Windows over event time, the same for tables and streams.

The reference engine has no event-time streaming; this is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _waiting(events: DataFrame, late: str | None) -> DataFrame:
    """A stream with a watermark, for which event time must have a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late and events.isStreaming else events


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts and totals by window and event type; `late`: how long a stream waits for late events."""
    events = _waiting(events, late)
    rows = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str | None = None) -> DataFrame:
    events = _waiting(events, late)
    rows = events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """One row per user and stretch of events without a longer gap."""
    events = _waiting(events, late)
    rows = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_repeats(events: DataFrame, key: str, late: str) -> DataFrame:
    """Events of a stream whose key hasn't been seen within the watermark."""
    return _waiting(events, late).dropDuplicatesWithinWatermark([key])
