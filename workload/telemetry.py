"""Run analytics on ``events``: a user is a device, ``value`` an increment, an event type a counter or stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.functions.units import epoch_us
from vektorloom.operators import telemetry as tm
from vektorloom.operators.series import gap_sessions, running_sum, running_sums
from workload.registry import query, table

DAY_US = 86_400_000_000
#: slice length of the series windows, in microseconds
WIDTH = 5 * DAY_US


def samples(spark, sf):
    return table(spark, sf, "events").select(
        "user_id", epoch_us(F.col("ts")).alias("us"), "event_id", "event_type", "value"
    )


EVENTS_SQL = "SELECT user_id, epoch_us(ts) AS us, event_id, event_type, value FROM events"
TYPES = ("click", "error", "purchase", "signup", "view")


def daily_counters(spark, sf):
    """One sample per user and day: five counters that only grow."""
    days = samples(spark, sf).withColumn("day", F.expr(f"us div {DAY_US}"))
    moved = days.groupBy("user_id", "day").agg(
        *[F.round(F.sum(F.when(F.col("event_type") == t, F.col("value")).otherwise(0.0)), 2).alias(f"inc_{t}") for t in TYPES]
    )
    grown = running_sums(moved, ["user_id"], ["day"], {t: F.col(f"inc_{t}") for t in TYPES}, 16)
    return grown.select("user_id", "day", *[F.round(t, 2).alias(t) for t in TYPES])


DAILY_SQL = (
    f"daily AS (SELECT user_id, us // {DAY_US} AS day, "
    + ", ".join(f"round(sum(CASE WHEN event_type = '{t}' THEN value ELSE 0 END), 2) AS inc_{t}" for t in TYPES)
    + f" FROM ({EVENTS_SQL}) GROUP BY ALL), counters AS (SELECT user_id, day, "
    + ", ".join(f"round(sum(inc_{t}) OVER w, 2) AS {t}" for t in TYPES)
    + " FROM daily WINDOW w AS (PARTITION BY user_id ORDER BY day)), deltas AS (SELECT user_id, day, "
    + ", ".join(f"{t} - lag({t}) OVER w AS d_{t}" for t in TYPES)
    + ", lag(day) OVER w AS before FROM counters WINDOW w AS (PARTITION BY user_id ORDER BY day))"
)


@query(
    f"WITH {DAILY_SQL} SELECT user_id, day, "
    + ", ".join(f"round(d_{t}, 2) AS delta_{t}" for t in TYPES)
    + ", round(" + " + ".join(f"d_{t}" for t in TYPES) + ", 2) AS total FROM deltas WHERE before IS NOT NULL"
)
def counter_deltas(spark, sf):
    deltas = tm.counter_deltas(daily_counters(spark, sf), ["user_id"], ["day"], TYPES, 16)
    return deltas.select(
        "user_id",
        "day",
        *[F.round(f"delta_{t}", 2).alias(f"delta_{t}") for t in TYPES],
        F.round(tm.row_total([f"delta_{t}" for t in TYPES]), 2).alias("total"),
    )


@query(
    f"WITH {DAILY_SQL} SELECT user_id, day, "
    + ", ".join(
        f"round(d_{t} * 100.0 / nullif({' + '.join(f'd_{x}' for x in TYPES)}, 0), 4) AS share_{t}" for t in TYPES
    )
    + " FROM deltas WHERE before IS NOT NULL"
)
def counter_share(spark, sf):
    deltas = tm.counter_deltas(daily_counters(spark, sf), ["user_id"], ["day"], TYPES, 16)
    shares = tm.state_shares(deltas.drop(*TYPES), TYPES)
    return shares.select("user_id", "day", *[F.round(f"share_{t}", 4).alias(f"share_{t}") for t in TYPES])


@query(
    f"""WITH c AS (SELECT *, sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sectors
      FROM ({EVENTS_SQL})),
    d AS (SELECT *, sectors - lag(sectors) OVER w AS moved, us - lag(us) OVER w AS elapsed FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
    SELECT user_id, event_id, sectors::BIGINT AS sectors,
      round(coalesce(moved / elapsed * 1e6 * 0.5 / 1024, 0), 6) AS mb_s FROM d"""
)
def disk_rate(spark, sf):
    rows = running_sum(
        samples(spark, sf), ["user_id"], ["us", "event_id"], F.round(F.col("value") * 100).cast("long"), WIDTH, "sectors"
    )
    rates = tm.disk_rates(rows, ["user_id"], ["us", "event_id"], ["sectors"], 1e6, WIDTH)
    return rates.select("user_id", "event_id", "sectors", F.round("mb_s_sectors", 6).alias("mb_s"))


@query(
    f"""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY us, event_id
      ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 4) AS smooth_value FROM ({EVENTS_SQL})"""
)
def smooth5(spark, sf):
    rows = tm.smoothed(samples(spark, sf), ["user_id"], ["us", "event_id"], "value", WIDTH)
    return rows.select("user_id", "event_id", F.round("smooth_value", 4).alias("smooth_value"))


def marks(spark, sf):
    """Every sign-up opens a stage named after its event."""
    return samples(spark, sf).where("event_type = 'signup'").select(
        "user_id", "us", F.concat(F.lit("stage-"), F.col("event_id").cast("string")).alias("tag")
    )


MARKS_SQL = f"marks AS (SELECT user_id, us, 'stage-' || event_id AS tag FROM ({EVENTS_SQL}) WHERE event_type = 'signup')"
ALIGNED_SQL = f"""{MARKS_SQL}, aligned AS (SELECT s.user_id, s.event_id, s.value, m.tag AS stage
    FROM ({EVENTS_SQL}) s ASOF LEFT JOIN marks m ON s.user_id = m.user_id AND s.us >= m.us)"""


def aligned(spark, sf):
    return tm.align_stages(samples(spark, sf), marks(spark, sf), ["user_id"], "us", "tag", WIDTH)


@query(f"WITH {ALIGNED_SQL} SELECT user_id, event_id, stage FROM aligned")
def stage_asof(spark, sf):
    return aligned(spark, sf).select("user_id", "event_id", "stage")


@query(
    f"""WITH {ALIGNED_SQL} SELECT user_id, stage, round(avg(value), 8) AS avg_value, max(value) AS max_value,
    count(*) AS n_samples FROM aligned GROUP BY user_id, stage"""
)
def stage_usage(spark, sf):
    rows = tm.stage_summary(aligned(spark, sf), ["user_id"], "value")
    return rows.withColumn("avg_value", F.round("avg_value", 8))


@query(
    f"WITH {MARKS_SQL} SELECT user_id, us, tag, lead(us) OVER (PARTITION BY user_id ORDER BY us, tag) - us AS duration FROM marks"
)
def stage_duration(spark, sf):
    return tm.stage_durations(marks(spark, sf), ["user_id"], ["us", "tag"], WIDTH)


@query(
    """WITH d AS (SELECT user_id, event_type AS stage, sum(value) AS duration FROM events GROUP BY ALL)
    SELECT user_id, stage, round(sum(duration) OVER (PARTITION BY user_id), 4) AS total,
    round(duration * 100.0 / nullif(sum(duration) OVER (PARTITION BY user_id), 0), 4) AS share FROM d"""
)
def stage_share(spark, sf):
    durations = samples(spark, sf).groupBy("user_id", F.col("event_type").alias("stage")).agg(
        F.sum("value").alias("duration")
    )
    shares = tm.stage_shares(durations, ["user_id"])
    return shares.select("user_id", "stage", F.round("total", 4).alias("total"), F.round("share", 4).alias("share"))


@query(
    f"SELECT user_id, event_id, round((us - min(us) OVER (PARTITION BY user_id)) / 1e6, 6) AS seconds FROM ({EVENTS_SQL})"
)
def relative_time(spark, sf):
    rows = tm.relative_seconds(samples(spark, sf), ["user_id"], "us", 1e6)
    return rows.select("user_id", "event_id", F.round("seconds", 6).alias("seconds"))


@query(
    """SELECT user_id, event_id, round((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 0.1::DOUBLE, 4) AS seconds
    FROM (SELECT user_id, event_id FROM events)"""
)
def index_time(spark, sf):
    rows = tm.indexed_seconds(samples(spark, sf), ["user_id"], ["event_id"], 0.1, 4096)
    return rows.select("user_id", "event_id", F.round("seconds", 4).alias("seconds"))


@query(
    f"""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id, us // {DAY_US} ORDER BY event_id
      ROWS UNBOUNDED PRECEDING), 4) AS stacked FROM ({EVENTS_SQL})"""
)
def stacked_sum(spark, sf):
    rows = samples(spark, sf).withColumn("day", F.expr(f"us div {DAY_US}"))
    stacked = tm.stacked_sums(rows, ["user_id", "day"], "event_id", "value")
    return stacked.select("user_id", "event_id", F.round("stacked", 4).alias("stacked"))


@query(
    f"""SELECT user_id, us // {DAY_US} AS day, round(sum(round(value * 10000000)::BIGINT) / 1073741824.0, 6) AS used_gib
    FROM ({EVENTS_SQL}) GROUP BY ALL"""
)
def process_memory(spark, sf):
    used = F.struct(
        F.col("event_id").alias("pid"), F.round(F.col("value") * 10000000).cast("long").alias("used_gpu_memory")
    )
    # processes of one device and day, as nested in a recorded sample
    nested = samples(spark, sf).groupBy("user_id", F.expr(f"us div {DAY_US}").alias("day")).agg(
        F.collect_list(used).alias("per_process_gpu_metrics")
    )
    rows = tm.process_memory(nested, ["user_id", "day"])
    return rows.select("user_id", "day", F.round("used_gib", 6).alias("used_gib"))


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 8) AS mean, round(quantile_cont(value, 0.5), 4) AS p50,
    round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type"""
)
def latency_percentiles(spark, sf):
    report = tm.latency_report(samples(spark, sf), "event_type", "value")
    return report.select(
        "event_type", "n", F.round("mean", 8).alias("mean"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95")
    )


@query(
    f"""SELECT user_id, count(*) AS n, round((max(us) - min(us)) / 1e6, 4) AS span_s,
    round(count(*) / nullif((max(us) - min(us)) / 1e6, 0), 10) AS per_second FROM ({EVENTS_SQL}) GROUP BY user_id"""
)
def throughput(spark, sf):
    rows = tm.throughput(samples(spark, sf), ["user_id"], "us", 1e6)
    return rows.select("user_id", "n", F.round("span_s", 4).alias("span_s"), F.round("per_second", 10).alias("per_second"))


@query("SELECT event_id, user_id, c_name AS device FROM events LEFT JOIN customer ON user_id = c_custkey")
def device_names(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("device"))
    return tm.with_dimension(samples(spark, sf).select("event_id", "user_id"), names, ["user_id"])


@query("SELECT event_type, CAST(floor(value) AS BIGINT) AS size, count(*) AS n FROM events GROUP BY ALL")
def size_histogram(spark, sf):
    sized = samples(spark, sf).select("event_type", F.floor("value").cast("long").alias("size"))
    return tm.value_histogram(sized, ["event_type"], "size")


GAP_US = 2 * 3_600 * 1_000_000
SESSIONS_SQL = f"""SELECT user_id, min(us) AS session_start, max(us) AS session_last, count(*) AS n_rows FROM (
      SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM (
        SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) <= {GAP_US} THEN 0 ELSE 1 END AS opens
        FROM ({EVENTS_SQL}))) GROUP BY user_id, no"""


@query(SESSIONS_SQL)
def sessions(spark, sf):
    return gap_sessions(samples(spark, sf), ["user_id"], ["us", "event_id"], GAP_US, WIDTH).drop("session_no")
