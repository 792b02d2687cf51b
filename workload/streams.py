"""Streaming jobs run to the end of the landed files, and the batch twin of the windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.collections.store import Collections, apply_changes
from vektorloom.functions.units import epoch_us
from vektorloom.session import scratch_path
from vektorloom.streaming import jobs
from workload.registry import query, table
from workload.telemetry import EVENTS_SQL, GAP_US, WIDTH

EVENT_COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark, sf):
    return jobs.read_landed(spark, f"{sf}/events*.parquet", EVENT_COLUMNS).withColumn(
        "at", F.timestamp_micros(epoch_us(F.col("ts")))
    )


def finished(spark, stream, name):
    """Run an append-mode stream over everything that has landed and read its output."""
    out = scratch_path(spark, name)
    cores = spark.sparkContext.defaultParallelism
    jobs.write_table(stream, out, scratch_path(spark, f"{name}-progress"), state_partitions=cores).awaitTermination()
    return spark.read.parquet(out)


DAYS_SQL = """SELECT event_type, epoch_us(date_trunc('day', ts)) AS day_us, round(sum(value), 2) AS total,
    round(avg(value), 8) AS mean, max(value) AS peak, count(*) AS n FROM events GROUP BY ALL"""


@query(DAYS_SQL)
def window_daily(spark, sf):
    """The stream's windows over a table."""
    rows = table(spark, sf, "events").withColumn("at", F.timestamp_micros(epoch_us(F.col("ts"))))
    totals = jobs.windowed_usage(rows, ["event_type"], "at", "value", "1 day")
    return totals.select(
        "event_type",
        F.unix_micros("window_start").alias("day_us"),
        F.round("total", 2).alias("total"),
        F.round("mean", 8).alias("mean"),
        "peak",
        "n",
    )


@query(
    f"""SELECT * FROM ({DAYS_SQL}) WHERE day_us + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""
)
def stream_windows(spark, sf):
    """Tumbling windows that the watermark has closed."""
    totals = jobs.windowed_usage(event_stream(spark, sf), ["event_type"], "at", "value", "1 day", late="1 hour")
    rows = finished(spark, totals, "windows")
    return rows.select(
        "event_type",
        F.unix_micros("window_start").alias("day_us"),
        F.round("total", 2).alias("total"),
        F.round("mean", 8).alias("mean"),
        "peak",
        "n",
    )


@query(
    """WITH w AS (SELECT event_type, value, epoch_us(date_trunc('day', ts)) - back * 43200000000 + CASE WHEN
      hour(ts) >= 12 THEN 43200000000 ELSE 0 END AS start_us FROM events, (VALUES (0), (1)) AS o(back))
    SELECT event_type, start_us, round(sum(value), 2) AS total, count(*) AS n FROM w GROUP BY ALL
    HAVING start_us + 86400000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""
)
def stream_sliding(spark, sf):
    """Day-long windows every 12 hours."""
    totals = jobs.windowed_usage(event_stream(spark, sf), ["event_type"], "at", "value", "1 day", "12 hours", "1 hour")
    rows = finished(spark, totals, "sliding")
    return rows.select(
        "event_type", F.unix_micros("window_start").alias("start_us"), F.round("total", 2).alias("total"), "n"
    )


@query(
    f"""SELECT user_id, min(us) AS session_start, max(us) AS session_last, count(*) AS n_rows FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM (
        SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {GAP_US} THEN 0 ELSE 1 END AS opens
        FROM ({EVENTS_SQL}))) GROUP BY user_id, no
    HAVING max(us) + {GAP_US} <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""
)
def stream_sessions(spark, sf):
    """Sessions with a 2-hour gap that the watermark has closed."""
    rows = finished(spark, jobs.run_sessions(event_stream(spark, sf), ["user_id"], "at", "2 hours"), "sessions")
    return rows.select(
        "user_id",
        F.unix_micros("session_start").alias("session_start"),
        F.unix_micros("session_last").alias("session_last"),
        "n_rows",
    )


@query(
    f"""WITH c AS (SELECT user_id, us, event_id, event_id * 1000 + round(value * 100)::BIGINT AS sectors FROM ({EVENTS_SQL})),
    d AS (SELECT *, sectors - lag(sectors) OVER w AS moved, us - lag(us) OVER w AS elapsed FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    SELECT user_id, event_id, round(CASE WHEN elapsed IS NULL THEN 0 WHEN moved >= 0 THEN moved / elapsed * 1e6 * 0.5 / 1024 END, 6)
      AS mb_s FROM d"""
)
def stream_rates(spark, sf):
    """Counter rate per device with the last sample kept between micro-batches."""
    counted = event_stream(spark, sf).select(
        "user_id",
        epoch_us(F.col("ts")).alias("us"),
        "event_id",
        (F.col("event_id") * 1000 + F.round(F.col("value") * 100).cast("long")).alias("sectors"),
    )
    out = scratch_path(spark, "rates")
    job = jobs.rate_stream(
        counted, ["user_id"], ["us", "event_id"], ["sectors"], out, scratch_path(spark, "rates-state"),
        scratch_path(spark, "rates-progress"), 1e6, WIDTH,
    )
    job.awaitTermination()
    return spark.read.parquet(out).select("user_id", "event_id", F.round("mb_s_sectors", 6).alias("mb_s"))


@query(
    """SELECT user_id::VARCHAR AS id, event_type AS text, event_id AS version FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""
)
def stream_upserts(spark, sf):
    """The latest event of every user, applied to a collection by a stream."""
    store = Collections(spark, scratch_path(spark, "upserts"), "upserts")
    store.create("latest_events", 1)
    changes = event_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("id"),
        F.col("event_type").alias("text"),
        F.array(F.col("value").cast("float")).alias("vector"),
        F.col("event_id").alias("version"),
    )
    jobs.upsert_stream(changes, store, "latest_events", scratch_path(spark, "upserts-progress")).awaitTermination()
    return store.scan("latest_events").select("id", "text", "version")


@query(
    """WITH feed AS (SELECT user_id, event_id, event_type, value FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT coalesce(f.user_id, c.c_custkey) AS id, f.event_type AS text, coalesce(f.value, c.c_acctbal) AS value
    FROM customer c FULL JOIN feed f ON c.c_custkey = f.user_id WHERE f.event_type IS NULL OR f.event_type <> 'error'"""
)
def change_feed(spark, sf):
    """Customers with a feed of changes: an error event deletes, any other replaces or inserts."""
    current = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.lit(None).cast("string").alias("text"), F.col("c_acctbal").cast("double").alias("value")
    )
    feed = table(spark, sf, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("text"),
        "value",
        F.col("event_id").alias("version"),
        F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("op"),
    )
    return apply_changes(current, feed)
