"""Streaming daily activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def daily_stream(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Events per UTC day; rows later than ``lateness`` behind the newest are dropped."""
    windows = events.withWatermark("event_time", lateness).groupBy(F.window("event_time", "1 day"))
    return windows.count().select(F.to_date("window.start").alias("date"), "count")
