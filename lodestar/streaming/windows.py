"""Event-time windows. Each works on a batch and, after withWatermark, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str) -> DataFrame:
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, width: str, step: str) -> DataFrame:
    return events.groupBy(F.window(F.col("ts").cast("timestamp"), width, step).alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, key: str, gap: str) -> DataFrame:
    """Runs of a key's events with less than `gap` between neighbours."""
    return events.groupBy(F.session_window(F.col("ts").cast("timestamp"), gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def rate_limited(requests: DataFrame, key: str, width: str, most: int) -> DataFrame:
    """Fixed windows in which a key asked more often than `most`, with how many requests were refused."""
    counts = requests.groupBy(key, F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most).select(key, F.col("w.start").alias("start"), "n", (F.col("n") - most).alias("refused"))
