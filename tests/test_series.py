"""Sliced windows equal plain windows over the whole series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vektorloom.operators import series, telemetry

ORDER = ["ts", "n"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(11)
    data = []
    for n in range(900):
        device = "hot" if n % 3 else draw.choice("abc")  # one device holds most rows
        mark = f"m{n}" if draw.random() < 0.1 else None
        data.append((device, draw.choice([5, 400, 1000, 3000]) * draw.randint(0, 9), n, draw.randint(0, 50), mark))
    df = spark.createDataFrame(data, "dev string, ts long, n long, x long, mark string")
    return df.repartition(7).persist()


def whole():
    return Window.partitionBy("dev").orderBy(*ORDER)


def same(got, want):
    key = ["dev", "n"]
    assert got.orderBy(*key).collect() == want.orderBy(*key).collect()


@pytest.mark.parametrize("width", [1, 7, 1000, 10**9])
@pytest.mark.parametrize("following", [False, True])
def test_neighbour(rows, width, following):
    shift = F.lead if following else F.lag
    got = series.with_neighbour(rows, ["dev"], ORDER, {"ts": "ts2", "x": "x2"}, width, following)
    want = rows.withColumn("ts2", shift("ts").over(whole())).withColumn("x2", shift("x").over(whole()))
    same(got, want)


@pytest.mark.parametrize("width", [1, 450, 10**9])
def test_running_sums(rows, width):
    upto = whole().rowsBetween(Window.unboundedPreceding, 0)
    got = series.running_sums(rows, ["dev"], ORDER, {"a": F.col("x"), "b": F.lit(1).cast("long")}, width)
    same(got, rows.withColumn("a", F.sum("x").over(upto)).withColumn("b", F.count("*").over(upto)))


@pytest.mark.parametrize("width", [1, 450, 10**9])
def test_last_known(rows, width):
    upto = whole().rowsBetween(Window.unboundedPreceding, 0)
    got = series.last_known(rows, ["dev"], ORDER, "mark", width, "m")
    same(got, rows.withColumn("m", F.last("mark", ignorenulls=True).over(upto)))


@pytest.mark.parametrize("width", [1, 13, 450, 10**9])
@pytest.mark.parametrize("points", [3, 5, 7])
def test_centred_mean(rows, width, points):
    half = points // 2
    near = F.sum(F.col("x").cast("double")).over(whole().rowsBetween(-half, half)) / points
    got = series.centred_mean(rows, ["dev"], ORDER, "x", width, "m", points)
    same(got.withColumn("m", F.round("m", 9)), rows.withColumn("m", F.round(near, 9)))


@pytest.mark.parametrize("width", [1, 450, 10**9])
def test_sessions_equal_session_windows(rows, width):
    got = series.gap_sessions(rows, ["dev"], ORDER, 60, width)
    stamped = rows.withColumn("at", F.timestamp_seconds("ts"))
    want = stamped.groupBy("dev", F.session_window("at", "60 seconds")).agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("session_last"), F.count("*").alias("n_rows")
    )
    columns = ["dev", "session_start", "session_last", "n_rows"]
    assert got.select(columns).orderBy(columns).collect() == want.select(columns).orderBy(columns).collect()


def test_no_window_over_a_whole_series(rows):
    """Row-level windows are partitioned by series and slice; only edges go by series."""
    plan = telemetry.smoothed(rows, ["dev"], ORDER, "x", 100)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_counter_reset_gives_null(spark):
    data = [("r", 1, 10, 5), ("r", 2, 14, 5), ("r", 3, 2, 5), ("r", 4, 2, 5)]
    df = spark.createDataFrame(data, "run string, ts long, user long, idle long")
    deltas = telemetry.counter_deltas(df, ["run"], ["ts"], ["user", "idle"], 2)
    assert [(r.ts, r.delta_user, r.delta_idle) for r in deltas.orderBy("ts").collect()] == [(2, 4, 0), (3, None, 0), (4, 0, 0)]
    shares = telemetry.state_shares(deltas, ["user", "idle"]).orderBy("ts").collect()
    # a sample without any movement has no share instead of a division by zero
    assert [(r.share_user, r.share_idle) for r in shares] == [(100.0, 0.0), (None, None), (None, None)]


def test_disk_rate(spark):
    data = [("r", "sda", 0, 0, 0), ("r", "sda", 1_000_000_000, 2048, 4096), ("r", "sda", 3_000_000_000, 2048, 8192)]
    df = spark.createDataFrame(data, "run string, dev string, ts_ns long, sectors_read long, sectors_written long")
    got = telemetry.disk_rates(df, ["run", "dev"], ["ts_ns"]).orderBy("ts_ns").collect()
    assert [(r.mb_s_sectors_read, r.mb_s_sectors_written) for r in got] == [(0.0, 0.0), (1.0, 2.0), (0.0, 1.0)]


def test_stage_alignment_and_durations(spark):
    samples = spark.createDataFrame([("r", t, float(t)) for t in (1, 5, 9, 10, 30)], "run string, ts long, x double")
    marks = spark.createDataFrame([("r", 5, "embed"), ("r", 10, "a"), ("r", 10, "b")], "run string, ts long, tag string")
    for width in (1, 4, 100):
        got = telemetry.align_stages(samples, marks, ["run"], "ts", "tag", width).orderBy("ts").collect()
        assert [r.stage for r in got] == [None, "embed", "embed", "b", "b"]
        durations = telemetry.stage_durations(marks, ["run"], ["ts", "tag"], width).orderBy("ts", "tag").collect()
        assert [r.duration for r in durations] == [5, 0, None]


def test_shares_of_a_round(spark):
    df = spark.createDataFrame([("r", 1, "embed", 30), ("r", 1, "search", 10), ("r", 2, "embed", 0)], "run string, round int, stage string, duration long")
    got = telemetry.stage_shares(df, ["run", "round"]).orderBy("round", "stage").collect()
    assert [(r.total, r.share) for r in got] == [(40, 75.0), (40, 25.0), (0, None)]


def test_process_memory(spark):
    gib = 1024**3
    schema = "ts long, gpu int, procs array<struct<pid:int,used_gpu_memory:long>>"
    df = spark.createDataFrame([(1, 0, [(7, gib), (8, gib // 2)]), (1, 1, [])], schema)
    got = telemetry.process_memory(df, ["ts", "gpu"], "procs").orderBy("gpu").collect()
    assert [r.used_gib for r in got] == [1.5, 0.0]


def test_exact_quantiles(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    values = {
        "a": draw.normal(size=501),
        "b": np.repeat([1.0, 2.0], 200),
        "c": np.array([4.0]),
        "d": draw.exponential(size=400) ** 4,
        "e": np.append(draw.normal(size=300) * 1e-9, [1e12, -5.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    for accuracy in (3, 64, 10_000):
        got = telemetry.exact_quantiles(df, "k", "v", [0.0, 0.25, 0.5, 0.95, 1.0], accuracy).collect()
        assert len(got) == 25
        for r in got:
            assert r.value == pytest.approx(np.quantile(values[r.k], r.share), abs=1e-12)


def test_quantiles_of_many_rows_in_two_scans(spark, tmp_path):
    import numpy as np

    rows = spark.range(0, 200_000, numPartitions=7).select((F.col("id") % 3).alias("k"), (F.hash("id") % 50_000).cast("double").alias("v"))
    rows.write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    shares = [0.001, 0.01, 0.5, 0.501, 0.95, 0.999]
    found = telemetry.exact_quantiles(df, "k", "v", shares, 500)
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
    values = {}
    for k, v in df.collect():
        values.setdefault(k, []).append(v)
    got = found.collect()
    assert len(got) == 18 and all(r.value == pytest.approx(np.quantile(values[r.k], r.share), abs=1e-9) for r in got)
    report = telemetry.latency_report(df, "k", "v").orderBy("k").collect()
    assert [(r.n, r.mean) for r in report] == [(len(values[k]), pytest.approx(np.mean(values[k]))) for k in range(3)]


def test_silent_series_are_left_out(spark):
    df = spark.createDataFrame([("a", 0), ("a", 0), ("b", 0), ("b", 3), ("c", None)], "dev string, x long")
    assert {r.dev for r in telemetry.moving_series(df, ["dev"], "x").collect()} == {"b"}
