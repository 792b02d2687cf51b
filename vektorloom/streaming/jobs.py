"""Structured Streaming jobs over landed sample files.

Every job takes a streaming DataFrame and a folder for its progress; the tests compare each with
its batch twin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from vektorloom.collections.deltas import Deltas
from vektorloom.collections.store import Collections
from vektorloom.operators.ranking import latest_per_key
from vektorloom.operators.telemetry import disk_rates
from vektorloom.operators.spread import send_if_small

#: Batches after which the state's change sets are folded.
COMPACT_EVERY = 16


def read_landed(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of parquet files arriving below a path."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def windowed_usage(
    stream: DataFrame,
    keys: Sequence[str],
    at: str,
    value: str,
    length: str,
    slide: str | None = None,
    late: str = "1 hour",
) -> DataFrame:
    """Tumbling or sliding aggregates; rows later than ``late`` are dropped.

    Partial aggregation runs before the shuffle, so a busy key adds one row per window and task.
    """
    window = F.window(at, length, slide) if slide else F.window(at, length)
    grouped = stream.withWatermark(at, late).groupBy(window.alias("w"), *keys)
    totals = grouped.agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("peak"), F.count("*").alias("n"))
    return totals.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total", "mean", "peak", "n")


def run_sessions(stream: DataFrame, keys: Sequence[str], at: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of rows closer than ``gap``: start, last row time and count.

    With ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` (set by ``local_session``; a cluster's session
    should set it too) sessions are merged inside each task first, so a busy key does not travel row by row.
    """
    grouped = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys)
    spans = grouped.agg(F.min(at).alias("session_start"), F.max(at).alias("session_last"), F.count("*").alias("n_rows"))
    return spans.drop("w")


def write_table(
    stream: DataFrame, path: str, progress: str, state_partitions: int | None = None, **trigger
) -> StreamingQuery:
    """Append finished rows to parquet.

    ``state_partitions`` is fixed with the first run of a job; by default it is the session's
    number of shuffle partitions.
    """
    conf = stream.sparkSession.conf
    before = conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", str(state_partitions or before))
    try:
        return _start_table(stream, path, progress, trigger)
    finally:
        conf.set("spark.sql.shuffle.partitions", before)


def _start_table(stream: DataFrame, path: str, progress: str, trigger: dict) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def rate_stream(
    stream: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    counters: Sequence[str],
    out: str,
    state: str,
    progress: str,
    ticks_per_second: float,
    width: int,
    idle: int | None = None,
    **trigger,
) -> StreamingQuery:
    """Counter rate per device across micro-batches.

    The state is the last sample of every device, kept as change sets per bucket of devices: a batch reads the state of
    its own devices and writes their new last samples, nothing of the others. The rates inside a batch use the sliced
    windows: a device with most of the rows is still split over tasks, which a state function per device could not do.

    A sample that is not newer than its device's last one is late: it gives no rate and is written to
    ``{out}-late`` with its batch. A device without a sample for ``idle`` ticks of the first order column (measured from
    the newest sample of all) loses its state; its next sample counts as a first one.
    """
    columns = [*keys, *order, *counters]

    def one_batch(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        kinds = {f.name: f.dataType for f in rows.schema}
        names = [T.StructField("id", T.StringType()), T.StructField("version", T.LongType())]
        last = Deltas(spark, state, T.StructType([*names, *[T.StructField(c, kinds[c]) for c in columns]]), "id")
        device = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        if last.applied(("rates", number)):  # a repeated batch sees the state as it was before it
            last = last.before(("rates", number))
        rows = rows.withColumn("id", device).persist()
        known = last.resolved().where("NOT _erase").join(send_if_small(rows.select("id").distinct()), "id", "left_semi")
        if idle is not None:
            newest = rows.agg(F.max(order[0])).first()[0]
            known = known.where(F.col(order[0]) >= F.lit((newest or 0) - idle))
        known = known.select("id", *columns).persist()
        ends = known.select("id", F.struct(*order).alias("_last"))
        marked = rows.join(send_if_small(ends), "id", "left")
        in_time = F.col("_last").isNull() | (F.struct(*order) > F.col("_last"))
        late = marked.where(~in_time).select(*columns)
        late.write.mode("overwrite").parquet(f"{out}-late/batch={number}")
        fresh = marked.where(in_time).select("id", *columns, F.lit(False).alias("_old"))
        both = fresh.unionByName(known.withColumn("_old", F.lit(True)))
        rates = disk_rates(both.drop("id"), keys, order, counters, ticks_per_second, width)
        rates.where(~F.col("_old")).drop("_old").write.mode("overwrite").parquet(f"{out}/batch={number}")
        newest_rows = latest_per_key(fresh.drop("_old"), ["id"], order).withColumn("version", F.lit(number).cast("long"))
        last.put(newest_rows, ("rates", number))
        if number % COMPACT_EVERY == COMPACT_EVERY - 1:
            last.compact()
        rows.unpersist()
        known.unpersist()

    return (
        stream.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def upsert_stream(
    changes: DataFrame, store: Collections, name: str, progress: str, key: str = "id", version: str = "version", **trigger
) -> StreamingQuery:
    """Apply a stream of changed rows to a collection; a batch writes its changes only, and a repeated batch nothing."""

    def one_batch(batch: DataFrame, number: int) -> None:
        store.upsert(name, batch, key, version, token=(progress, number))

    return (
        changes.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", progress)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
