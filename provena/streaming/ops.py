"""Structured Streaming forms that also work on tables: usage rollups, request histograms, sessions, upserts.  Keyed state is in ``state``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_rollup(events: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "10 minutes", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time window; works on a stream and on a table."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), *keys, "n", "value")


def request_histogram(events: DataFrame, bounds: list[float], at: str = "ts", window: str = "1 hour", late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Cumulative buckets by window."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    b = F.array(*[F.struct(F.lit(float(x)).alias("le"), F.count_if(F.col("value") <= x).alias("n")) for x in bounds])
    return e.groupBy(F.window(at, window), key).agg(b.alias("b")).select(F.col("window.start").alias("start"), key, F.inline("b"))


def sessions(events: DataFrame, at: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def unique_messages(stream: DataFrame, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
