"""Metric files and stage marks of recorded runs -> tables per meter and stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorloom.operators.telemetry import (
    CPU_STATES,
    HOUR_NS,
    align_stages,
    counter_deltas,
    disk_rates,
    process_memory,
    relative_seconds,
    stage_durations,
    stage_summary,
    state_shares,
)
from vektorloom.operators.series import with_neighbour
from vektorloom.sources.framed import cpu_total, memory_gib, per_device, read_metadata, read_metrics
from vektorloom.sources.logs import read_marks
from vektorloom.sources.messages import GPM_NAMES


def cpu_shares(spark: SparkSession, path: str, width: int = HOUR_NS) -> DataFrame:
    """Percentage of each CPU state between consecutive samples of every run."""
    samples = cpu_total(read_metrics(spark, path, "cpu"))
    deltas = counter_deltas(samples, ["run"], ["ts_ns", "sample_idx"], CPU_STATES, width)
    shares = state_shares(deltas.drop(*CPU_STATES), CPU_STATES)
    return relative_seconds(shares, ["run"], "ts_ns")


def disk_bandwidth(spark: SparkSession, path: str, width: int = HOUR_NS) -> DataFrame:
    """Read and write MB/s per device position."""
    devices = per_device(read_metrics(spark, path, "disk"), "disk_metrics", "disk")
    rows = devices.select("run", "disk", "sample_idx", "ts_ns", "sectors_read", "sectors_written")
    return disk_rates(rows, ["run", "disk"], ["ts_ns", "sample_idx"], width=width)


def gpu_values(spark: SparkSession, path: str) -> DataFrame:
    """One row per sample, GPU and requested metric position."""
    samples = per_device(read_metrics(spark, path, "gpu"), "per_gpu_metrics", "gpu")
    return samples.select("run", "gpu", "sample_idx", "ts_ns", F.posexplode("gpm_metrics_values").alias("position", "value"))


def gpu_memory(spark: SparkSession, path: str) -> DataFrame:
    """GiB in use per sample and GPU."""
    samples = per_device(read_metrics(spark, path, "gpu"), "per_gpu_metrics", "gpu")
    return process_memory(samples, ["run", "gpu", "sample_idx", "ts_ns"])


def memory(spark: SparkSession, path: str, period: float = 0.1) -> DataFrame:
    return memory_gib(read_metrics(spark, path, "mem"), period)


def stages(spark: SparkSession, path: str, width: int = HOUR_NS) -> DataFrame:
    """Stage marks with the time to the next mark."""
    return stage_durations(read_marks(spark, path), ["run"], ["ts_ns", "tag"], width)


def cpu_by_stage(spark: SparkSession, path: str, state: str = "user", width: int = HOUR_NS) -> DataFrame:
    """Average and peak share of a CPU state in every stage of every run."""
    aligned = align_stages(cpu_shares(spark, path, width), read_marks(spark, path), ["run"], "ts_ns", "tag", width)
    return stage_summary(aligned, ["run"], f"share_{state}")


# ---- names of devices, metrics and processes ----------------------------------

#: Files that hold the message naming a meter's devices.
METADATA_FILES = "*Meta*.pb.bin"


def disk_names(spark: SparkSession, path: str, pattern: str = METADATA_FILES) -> DataFrame:
    """``run, disk, device``: the name of each disk position."""
    found = read_metadata(spark, path, "disk", pattern)
    return found.select("run", F.posexplode("disk_meta").alias("disk", "_d")).select(
        "run", F.col("disk").cast("long").alias("disk"), F.col("_d.dev_name").alias("device")
    )


def gpu_metric_names(spark: SparkSession, path: str, pattern: str = METADATA_FILES) -> DataFrame:
    """``run, position, metric``: the metric at each position of the recorded values."""
    found = read_metadata(spark, path, "gpu", pattern).select("run", F.posexplode("gpm_metrics").alias("position", "number"))
    names = spark.createDataFrame(list(GPM_NAMES.items()), "number long, metric string")
    named = found.distinct().join(F.broadcast(names), "number", "left")  # a fixed list
    return named.select("run", F.col("position").cast("long").alias("position"), F.coalesce("metric", F.concat(F.lit("GPM_"), "number")).alias("metric"))


def process_names(spark: SparkSession, path: str, pattern: str = METADATA_FILES) -> DataFrame:
    """``run, process, pid, name``: the process at each position."""
    found = read_metadata(spark, path, "proc", pattern)
    return found.select("run", F.posexplode("proc_meta").alias("process", "_p")).select(
        "run", F.col("process").cast("long").alias("process"), F.col("_p.pid").alias("pid"), F.col("_p.proc_name").alias("name")
    )


# ---- processes ----------------------------------------------------------------


def process_usage(
    spark: SparkSession, path: str, ticks_per_second: int = 100, page_bytes: int = 4096, width: int = HOUR_NS
) -> DataFrame:
    """Per process and sample: CPU use in percent of a core, resident GiB, and MB/s read and written.

    CPU time counts in ticks, resident memory in pages. Rates of a process's first sample, and after a counter went
    backwards, are NULL.
    """
    each = per_device(read_metrics(spark, path, "proc"), "per_proc_metrics", "process")
    busy = F.col("pid_stat_metrics.utime") + F.col("pid_stat_metrics.stime")
    rows = each.select(
        "run",
        "process",
        "sample_idx",
        "ts_ns",
        busy.alias("busy"),
        F.col("pid_statm_metrics.resident").alias("pages"),
        F.col("pid_io_metrics.read_bytes").alias("read"),
        F.col("pid_io_metrics.write_bytes").alias("written"),
    )
    before = {c: f"_before_{c}" for c in ("ts_ns", "busy", "read", "written")}
    near = with_neighbour(rows, ["run", "process"], ["ts_ns", "sample_idx"], before, width)
    seconds = (F.col("ts_ns") - F.col("_before_ts_ns")) / F.lit(1e9)

    def rate(counter: str, scale: float):
        moved = F.col(counter) - F.col(f"_before_{counter}")
        return F.when(moved >= 0, F.try_divide(moved * F.lit(scale), seconds))

    return near.select(
        "run",
        "process",
        "sample_idx",
        "ts_ns",
        rate("busy", 100.0 / ticks_per_second).alias("cpu_percent"),
        (F.col("pages") * page_bytes / F.lit(float(1 << 30))).alias("resident_gib"),
        rate("read", 1.0 / (1 << 20)).alias("mb_s_read"),
        rate("written", 1.0 / (1 << 20)).alias("mb_s_written"),
    )


# ---- all meters by stage ------------------------------------------------------


def measures(df: DataFrame, meter: str, device: str | None, columns: list[str]) -> DataFrame:
    """``run, ts_ns, meter, device, measure, value``: the columns of a meter as rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in columns])
    name = F.lit(None).cast("long") if device is None else F.col(device).cast("long")
    rows = df.select("run", "ts_ns", F.lit(meter).alias("meter"), name.alias("device"), F.explode(pairs).alias("_m"))
    return rows.select("run", "ts_ns", "meter", "device", "_m.measure", "_m.value")


def usage_by_stage(spark: SparkSession, path: str, width: int = HOUR_NS) -> DataFrame:
    """Average and peak of every measure of every meter in each stage of every run.

    Samples without a time (some memory samples) have no stage and are left out; so are samples before the first mark.
    """
    cpu = measures(cpu_shares(spark, path, width), "cpu", None, [f"share_{s}" for s in CPU_STATES])
    disk = measures(disk_bandwidth(spark, path, width), "disk", "disk", ["mb_s_sectors_read", "mb_s_sectors_written"])
    gpu = measures(gpu_memory(spark, path), "gpu", "gpu", ["used_gib"])
    values = gpu_values(spark, path).select(
        "run", "ts_ns", F.lit("gpu").alias("meter"), F.col("gpu").alias("device"), F.concat(F.lit("gpm_"), "position").alias("measure"), "value"
    )
    mem = read_metrics(spark, path, "mem")
    timed = memory_gib(mem).join(mem.select("run", "sample_idx", F.col("timestamp").alias("ts_ns")), ["run", "sample_idx"])
    memory_rows = measures(timed, "mem", None, ["free_gib", "available_gib", "buffers_gib", "cached_gib"])
    proc = measures(process_usage(spark, path, width=width), "proc", "process", ["cpu_percent", "resident_gib", "mb_s_read", "mb_s_written"])
    rows = cpu
    for more in (disk, gpu, values, memory_rows, proc):
        rows = rows.unionByName(more)
    aligned = align_stages(rows.where("ts_ns IS NOT NULL"), read_marks(spark, path), ["run"], "ts_ns", "tag", width)
    return aligned.where("stage IS NOT NULL").groupBy("run", "stage", "meter", "device", "measure").agg(
        F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count("value").alias("n_samples")
    )
