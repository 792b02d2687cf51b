"""Stream jobs over several micro-batches equal their batch twins."""

from pyspark.sql import functions as F

from vektorloom.collections.store import Collections
from vektorloom.operators.telemetry import disk_rates
from vektorloom.streaming import jobs

SCHEMA = "dev string, ts long, n long, sectors long"


def landed(spark, path, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return jobs.read_landed(spark, path, SCHEMA, files_per_trigger=1)


def test_rates_across_batches(spark, tmp_path):
    batches = [
        [("a", 10, 1, 0), ("b", 10, 2, 100), ("a", 20, 3, 2048)],
        [("a", 30, 4, 6144), ("c", 5, 5, 7)],
        [("b", 20, 6, 50), ("a", 40, 7, 6144), ("a", 15, 8, 1)],  # a reset, and a row that comes too late
    ]
    stream = landed(spark, f"{tmp_path}/in", batches)
    paths = [f"{tmp_path}/{n}" for n in ("out", "state", "progress")]
    jobs.rate_stream(stream, ["dev"], ["ts", "n"], ["sectors"], *paths, 1.0, 8).awaitTermination()
    got = sorted((r.dev, r.ts, r.mb_s_sectors) for r in spark.read.parquet(paths[0]).collect())
    on_time = spark.createDataFrame([r for b in batches for r in b if r[2] != 8], SCHEMA)
    twin = disk_rates(on_time, ["dev"], ["ts", "n"], ["sectors"], 1.0, 8)
    assert got == sorted((r.dev, r.ts, r.mb_s_sectors) for r in twin.collect())
    assert ("a", 30, 0.2) in got and ("b", 20, None) in got and ("c", 5, 0.0) in got


def test_windows_drop_late_rows(spark, tmp_path):
    day = 86_400
    batches = [
        [("a", 10, 1, 5), ("a", day + 10, 2, 7)],
        [("a", 4 * day, 3, 1)],
        [("a", 5 * day, 5, 1)],
        [("a", 20, 4, 100), ("a", 8 * day, 6, 1)],  # the first row is days late
    ]
    stream = landed(spark, f"{tmp_path}/in", batches).withColumn("at", F.timestamp_seconds("ts"))
    totals = jobs.windowed_usage(stream, ["dev"], "at", "sectors", "1 day", late="1 hour")
    jobs.write_table(totals, f"{tmp_path}/out", f"{tmp_path}/progress").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").select(F.unix_seconds("window_start").alias("s"), "total")
    assert sorted(tuple(r) for r in got.collect()) == [(0, 5), (day, 7), (4 * day, 1), (5 * day, 1)]


def test_upserts(spark, tmp_path):
    store = Collections(spark, str(tmp_path / "store"), "stream_upserts")
    store.create("latest", 1)
    batches = [[("a", 1, 1, 10), ("b", 1, 2, 20)], [("a", 2, 3, 30), ("a", 0, 0, 5)], [("a", 1, 2, 15)]]
    stream = landed(spark, f"{tmp_path}/in", batches).select(
        F.col("dev").alias("id"),
        F.col("sectors").cast("string").alias("text"),
        F.array(F.col("sectors").cast("float")).alias("vector"),
        F.col("n").alias("version"),
    )
    jobs.upsert_stream(stream, store, "latest", f"{tmp_path}/progress").awaitTermination()
    got = store.scan("latest").orderBy("id").collect()
    assert [(r.id, r.text) for r in got] == [("a", "30"), ("b", "20")]
    store.drop("latest")


def test_late_and_idle_devices(spark, tmp_path):
    batches = [
        [("a", 10, 1, 0), ("b", 10, 2, 100), ("z", 10, 3, 5)],
        [("a", 20, 4, 2048), ("a", 9, 5, 7), ("a", 10, 1, 0)],  # two samples too late
        [("a", 500, 6, 4096), ("b", 505, 7, 300)],  # b was idle for 495
        [("b", 510, 8, 300 + 2048 * 5)],
    ]
    stream = landed(spark, f"{tmp_path}/in", batches)
    paths = [f"{tmp_path}/{n}" for n in ("out", "state", "progress")]
    jobs.rate_stream(stream, ["dev"], ["ts", "n"], ["sectors"], *paths, 1.0, 8, idle=490).awaitTermination()
    got = {(r.dev, r.n): r.mb_s_sectors for r in spark.read.parquet(paths[0]).collect()}
    assert got[("a", 4)] == 0.1 and got[("a", 6)] > 0 and got[("b", 7)] == 0.0 and got[("b", 8)] == 1.0 and len(got) == 7
    late = spark.read.parquet(f"{tmp_path}/out-late")
    assert sorted((r.dev, r.n, r.batch) for r in late.collect()) == [("a", 1, 1), ("a", 5, 1)]
    # a batch writes the state of its own devices only
    from vektorloom.collections.deltas import Deltas

    schema = "id string, version long, dev string, ts long, n long, sectors long"
    state = Deltas(spark, paths[1], spark.createDataFrame([], schema).schema, "id")
    sets = [s for b in state.manifest()["files"].values() for s, _ in b]
    assert len(sets) == 7 and {r.dev: r.n for r in state.resolved().collect()} == {"a": 6, "b": 8, "z": 3}


def test_a_repeated_batch_gives_the_same_rates(spark, tmp_path):
    """The progress of the last batch is lost after its results were written."""
    batches = [[("a", 10, 1, 0)], [("a", 20, 2, 2048), ("b", 3, 3, 1)], [("a", 30, 4, 6144)]]
    stream = landed(spark, f"{tmp_path}/in", batches)
    paths = [f"{tmp_path}/{n}" for n in ("out", "state", "progress")]
    run = lambda: jobs.rate_stream(stream, ["dev"], ["ts", "n"], ["sectors"], *paths, 1.0, 8).awaitTermination()
    run()
    before = sorted(map(str, spark.read.parquet(paths[0]).collect()))
    for name in ("commits/2", "commits/.2.crc"):
        (tmp_path / "progress" / name).unlink(missing_ok=True)
    run()
    assert sorted(map(str, spark.read.parquet(paths[0]).collect())) == before and len(before) == 4
