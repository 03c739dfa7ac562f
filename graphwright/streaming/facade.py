"""Streaming forms of windowed counts and open-close matching.

The analytics are batch; these take a streaming DataFrame of the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, lateness: str) -> DataFrame:
    """Counts per tumbling window; rows later than ``lateness`` are dropped."""
    return (
        stream.withWatermark(time, lateness)
        .groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count("*").alias("records"))
        .select(F.col("w.start").alias("window_start"), *keys, "records")
    )


def activity_sessions(stream: DataFrame, time: str, keys: list[str], gap: str, lateness: str) -> DataFrame:
    """One row for each stretch of activity without a gap."""
    return (
        stream.withWatermark(time, lateness)
        .groupBy(F.session_window(time, gap).alias("w"), *keys)
        .agg(F.count("*").alias("records"))
        .select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "records")
    )


def first_seen(stream: DataFrame, time: str, keys: list[str], lateness: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)
