"""Structured Streaming variants: rest-gap sessions and daily rates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_sessions(events: DataFrame, gap: str = "72 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user's events cut at gaps; works on batch and streaming input."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    g = timed.groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", F.round("total", 6).alias("total"))


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", late)
    g = timed.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("day"), "event_type", "events", "total")
