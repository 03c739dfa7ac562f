"""Streaming forms give the batch counts."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphwright.streaming import facade


@pytest.fixture
def stream(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(rows.schema).parquet(f"{sf_dir}/event*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df, mode):
    query = df.writeStream.format("memory").queryName("drained").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table("drained").collect()


def test_windowed_counts(stream, spark, sf_dir):
    got = drained(facade.windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour"), "complete")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_trunc("day", "ts").cast("timestamp").alias("d"), "event_type").collect()
    assert {(r.window_start, r.event_type): r.records for r in got} == Counter((r.d, r.event_type) for r in rows)


def test_sessions(stream):
    got = drained(facade.activity_sessions(stream, "ts", ["user_id"], "6 hours", "1 hour"), "append")
    assert all(r.started < r.ended and r.records > 0 for r in got)


def test_first_seen(stream):
    got = drained(facade.first_seen(stream, "ts", ["event_id"], "1 hour"), "append")
    assert len(got) == len({r.event_id for r in got})
