"""Streams of events: windows with watermarks, idempotent submits, totals and the latest state by key.

Each function takes a streaming DataFrame with an event time and returns a streaming DataFrame; the same
functions run on batch input, which is how tests compare them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Parquet files that match a path pattern as a stream; wall-clock times become instants of the session's zone."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, time: str, width: str, *measures: Column, slide: str | None = None, by: list[str] | None = None, late: str = LATE) -> DataFrame:
    """Measures of each tumbling (or, with ``slide``, sliding) window."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = events.withWatermark(time, late).groupBy(w, *(by or [])).agg(*measures)
    return out.select(F.col("window.start").alias("window_start"), *(c for c in out.columns if c != "window"))


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str = LATE) -> DataFrame:
    """Start, end and number of events of each session: a gap of that length ends it."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return out.select(*by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def once(events: DataFrame, time: str, keys: list[str], late: str = LATE) -> DataFrame:
    """The first event of each key within the watermark: a repeated submit is dropped."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def audit_totals(events: DataFrame, job: str, status: str, units: str, time: str) -> DataFrame:
    """Calls, successes, failures (all that did not succeed), timeouts, units, first and last time of each job."""
    n = lambda c: F.count(F.when(c, 1))
    s = F.col(status)
    return events.groupBy(job).agg(
        F.count("*").alias("calls"),
        n(s == "succeeded").alias("succeeded"),
        n(~s.eqNullSafe(F.lit("succeeded"))).alias("failed"),
        n(s == "timeout").alias("timeouts"),
        F.sum(units).alias("units"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def latest_state(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the last event of each key, kept as an aggregate, so that state is a row for each key."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
