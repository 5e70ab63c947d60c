"""Streaming operators, run to the end of their input and read back as tables."""

from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import scratch, table
from ..streaming import events as E


def drained(stream):
    """The totals a stream has reached once its input is used up, from a table that each trigger replaces."""
    spark = stream.sparkSession
    path = scratch(spark, "stream")

    def replace(batch, _):
        batch.write.mode("overwrite").parquet(path)

    run = stream.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark, d):
    return E.event_stream(spark, f"{d}/events.parquet*")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    out = E.windowed(_events(spark, d), "ts", "1 day", F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), by=["event_type"])
    return drained(out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"))


@query("""
SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value), 2) AS units FROM events GROUP BY 1""")
def stream_audit_totals(spark, d):
    e = _events(spark, d).withColumn("status", F.when(F.col("event_type") == "error", "failed").otherwise("succeeded"))
    out = E.audit_totals(e, "user_id", "status", "value", "ts")
    return drained(out.select("user_id", "calls", "succeeded", "failed", F.round("units", 2).alias("units")))


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def stream_latest_state(spark, d):
    return drained(E.latest_state(_events(spark, d), "user_id", "event_type", "event_id"))


@query("""
WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 1800000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM x) GROUP BY user_id, s""")
def session_counts(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(e, "ts", "30 minutes", ["user_id"]).select("user_id", "n")


@query("SELECT count(DISTINCT (user_id, event_type)) AS n FROM events")
def idempotent_events(spark, d):
    return E.once(table(spark, d, "events"), "ts", ["user_id", "event_type"]).agg(F.count("*").alias("n"))
