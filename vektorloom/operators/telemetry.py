"""Analytics over hardware samples and stage marks of a run.

Times are whole numbers of a monotonic clock (nanoseconds in metric files). Long series go through
the sliced windows of :mod:`vektorloom.operators.series`; ``width`` is the slice length in the unit
of the order column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektorloom.functions.units import bytes_to_gib
from vektorloom.operators.series import beside, centred_mean, last_known, running_sum, with_neighbour
from vektorloom.operators.spread import send_if_small

# The ten CPU states of one core sample.
CPU_STATES = (
    "user",
    "nice",
    "system",
    "idle",
    "iowait",
    "irq",
    "softirq",
    "steal",
    "guest",
    "guest_nice",
)

HOUR_NS = 3_600 * 1_000_000_000


def counter_deltas(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], counters: Sequence[str], width: int = HOUR_NS
) -> DataFrame:
    """Increase of every counter since the previous sample; the first sample of a series is dropped.

    A counter that went backwards (reset) gives NULL.
    """
    near = with_neighbour(df, keys, order, {c: f"_before_{c}" for c in [order[0], *counters]}, width)
    kept = near.where(F.col(f"_before_{order[0]}").isNotNull())
    increase = [_increase(c).alias(f"delta_{c}") for c in counters]
    return kept.select(*df.columns, *increase)


def _increase(counter: str) -> Column:
    gap = F.col(counter) - F.col(f"_before_{counter}")
    return F.when(gap >= 0, gap)


def state_shares(deltas: DataFrame, states: Sequence[str], prefix: str = "delta_") -> DataFrame:
    """Percentage of each state in the sum of all states; NULL where nothing moved."""
    total = sum((F.col(prefix + s) for s in states[1:]), F.col(prefix + states[0]))
    rest = [c for c in deltas.columns if c not in {prefix + s for s in states}]
    return deltas.select(
        *rest, *[F.try_divide(F.col(prefix + s) * 100.0, total).alias(f"share_{s}") for s in states]
    )


def row_total(columns: Sequence[str]) -> Column:
    """Sum of counters within one sample."""
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0]))


def disk_rates(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sectors: Sequence[str] = ("sectors_read", "sectors_written"),
    ticks_per_second: float = 1e9,
    width: int = HOUR_NS,
) -> DataFrame:
    """MB/s from 512-byte sector counters; the first sample of a device is 0."""
    at = order[0]
    near = with_neighbour(df, keys, order, {c: f"_before_{c}" for c in [at, *sectors]}, width)
    elapsed = F.col(at) - F.col(f"_before_{at}")

    def rate(counter: str) -> Column:
        moved = F.col(counter) - F.col(f"_before_{counter}")
        value = F.try_divide(moved.cast("double"), elapsed.cast("double")) * ticks_per_second * 0.5 / 1024
        return F.when(F.col(f"_before_{at}").isNull(), F.lit(0.0)).when(moved >= 0, value)

    return near.select(*df.columns, *[rate(c).alias(f"mb_s_{c}") for c in sectors])


def smoothed(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int = HOUR_NS, points: int = 5
) -> DataFrame:
    """Centred moving average with missing neighbours counted as 0."""
    return centred_mean(df, keys, order, value, width, f"smooth_{value}", points)


def stage_durations(
    marks: DataFrame, keys: Sequence[str], order: Sequence[str], width: int = HOUR_NS
) -> DataFrame:
    """Time from each stage mark to the next one; the last mark of a run has none."""
    near = with_neighbour(marks, keys, order, {order[0]: "_next"}, width, following=True)
    return near.select(*marks.columns, (F.col("_next") - F.col(order[0])).alias("duration"))


def with_group_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Group aggregates next to every row: partial aggregation and a join, no group-wide window.

    Few groups are sent to the rows, so the rows stay where they are.
    """
    grouped = df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in aggregates.items()])
    return beside(df, send_if_small(grouped), list(keys))


def stage_shares(durations: DataFrame, keys: Sequence[str], value: str = "duration") -> DataFrame:
    """Total of the stages of a round and each stage's percentage of it."""
    summed = with_group_values(durations, keys, total=F.sum(value))
    share = F.try_divide(F.col(value) * F.lit(100.0), F.col("total"))
    return summed.withColumn("share", share)


def relative_seconds(df: DataFrame, keys: Sequence[str], at: str, ticks_per_second: float = 1e9) -> DataFrame:
    """Seconds since the first sample of the run."""
    started = with_group_values(df, keys, _first=F.min(at))
    return started.withColumn("seconds", (F.col(at) - F.col("_first")) / F.lit(ticks_per_second)).drop("_first")


def indexed_seconds(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], period: float, width: int = 65_536
) -> DataFrame:
    """Time of samples without a timestamp: position in the run times the sampling period."""
    counted = running_sum(df, keys, order, F.lit(1).cast("long"), width, "_n")
    return counted.withColumn("seconds", (F.col("_n") - 1) * F.lit(period)).drop("_n")


def stacked_sums(df: DataFrame, sample: Sequence[str], slot: str, value: str) -> DataFrame:
    """Running total over the slots of one sample. A sample has a bounded number of slots."""
    upto = Window.partitionBy(*sample).orderBy(slot).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("stacked", F.sum(value).over(upto))


def process_memory(samples: DataFrame, keys: Sequence[str], processes: str = "per_process_gpu_metrics") -> DataFrame:
    """GiB used per sample and GPU, summed over processes; 0 without a process."""
    rows = samples.select(*keys, F.posexplode_outer(processes).alias("slot", "process"))
    return rows.groupBy(*keys).agg(
        bytes_to_gib(F.coalesce(F.sum("process.used_gpu_memory"), F.lit(0)).cast("double")).alias("used_gib")
    )


def align_stages(
    samples: DataFrame, marks: DataFrame, keys: Sequence[str], at: str, tag: str, width: int = HOUR_NS
) -> DataFrame:
    """As-of join: the latest mark at or before each sample of the same run.

    Both tables keep raw clock values; rebasing them separately would shift the overlay.
    """
    columns = samples.columns
    stamped = samples.withColumn("_kind", F.lit(1)).withColumn("_tag", F.lit(None).cast(marks.schema[tag].dataType))
    as_rows = marks.select(*keys, at, F.lit(0).alias("_kind"), F.col(tag).alias("_tag"))
    both = stamped.unionByName(as_rows, allowMissingColumns=True)
    known = last_known(both, keys, [at, "_kind", "_tag"], "_tag", width, "stage")
    return known.where(F.col("_kind") == 1).select(*columns, "stage")


def stage_summary(aligned: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average and peak of a measure per stage."""
    return aligned.groupBy(*keys, "stage").agg(
        F.avg(value).alias(f"avg_{value}"),
        F.max(value).alias(f"max_{value}"),
        F.count("*").alias("n_samples"),
    )


def with_dimension(df: DataFrame, dimension: DataFrame, on: Sequence[str]) -> DataFrame:
    """Names for positions or ids; unknown ones keep a NULL name."""
    return df.join(dimension, list(on), "left")


def only_members(df: DataFrame, members: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the chosen devices or processes."""
    return df.join(send_if_small(members.select(*on).distinct()), list(on), "left_semi")


def moving_series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows of the series that are not zero throughout."""
    moving = df.groupBy(*keys).agg(F.max(value).alias("_peak")).where("_peak > 0")
    return df.join(send_if_small(moving.select(*keys)), list(keys), "left_semi")


def throughput(df: DataFrame, keys: Sequence[str], at: str, ticks_per_second: float = 1e9) -> DataFrame:
    """Requests and requests per second between the first and the last one."""
    spans = df.groupBy(*keys).agg(
        F.count("*").alias("n"), ((F.max(at) - F.min(at)) / F.lit(ticks_per_second)).alias("span_s")
    )
    return spans.withColumn("per_second", F.try_divide(F.col("n").cast("double"), F.col("span_s")))


def exact_quantiles(df: DataFrame, key: str, value: str, shares: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """Exact interpolated quantiles per key in two passes, also for very large groups.

    The first pass makes a quantile sketch per key, whose ranks are off by at most ``rows / accuracy``; it gives an
    interval around each quantile that must hold it. The second pass counts: values inside an interval one by one, all
    others once per gap between the intervals, both with partial aggregation, so of a group only the distinct values
    near its quantiles (about ``8 / accuracy`` of its rows each, or all of fewer than ``accuracy`` rows) are put in order.
    A wrong interval would raise.
    """
    return _quantiles(df, key, value, shares, accuracy, {}).select(key, "share", "value")


def _quantiles(
    df: DataFrame, key: str, value: str, shares: Sequence[float], accuracy: int, extras: dict[str, Column]
) -> DataFrame:
    """``key, share, value`` and further aggregates of the first pass."""
    shares = sorted(set(shares))
    slack = 4.0 / accuracy  # the sketch's error, and up to two places of a group of at least ``accuracy`` rows
    rows = df.select(key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ends = [max(0.0, s - slack) for s in shares] + [min(1.0, s + slack) for s in shares]
    sketch = rows.groupBy(key).agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_p"), *[e.alias(n) for n, e in extras.items()]
    )
    lows, highs = ([F.col("_p")[i + at] for i in range(len(shares))] for at in (0, len(shares)))
    near = reduce(lambda a, b: a | b, [F.col("_v").between(low, high) for low, high in zip(lows, highs)])
    inside = near | (F.col("_n") < accuracy)
    beyond = reduce(lambda a, b: a + b, [F.when(F.col("_v") > high, 1).otherwise(0) for high in highs])
    gap = F.when(F.col("_n") < accuracy, 0).otherwise(beyond)
    carried = ["_n", *extras]
    placed = rows.join(sketch, key).select(key, *carried, gap.alias("_gap"), F.when(inside, F.col("_v")).alias("_x"))
    # values outside come before those inside the next interval, and NULL comes first
    counts = placed.groupBy(key, *carried, "_gap", "_x").agg(F.count("*").alias("_c"))
    lower = Window.partitionBy(key).orderBy("_gap", F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ordered = counts.withColumn("_from", F.coalesce(F.sum("_c").over(lower), F.lit(0)))
    positions = F.array(*[F.struct(F.lit(s).alias("share"), (F.lit(s) * (F.col("_n") - 1)).alias("_pos")) for s in shares])
    hit = lambda at: (at >= F.col("_from")) & (at < F.col("_from") + F.col("_c"))
    here = F.filter(positions, lambda t: hit(F.floor(t._pos)) | hit(F.ceil(t._pos)))
    found = ordered.select(key, *carried, "_x", F.explode(here).alias("_t"))
    known = F.when(F.col("_x").isNotNull(), F.col("_x")).otherwise(F.raise_error(F.lit("a quantile lies outside its interval")).cast("double"))
    between = found.groupBy(key, *carried, "_t.share", "_t._pos").agg(F.min(known).alias("_a"), F.max(known).alias("_b"))
    part = F.col("_pos") - F.floor("_pos")
    return between.withColumn("value", F.col("_a") + (F.col("_b") - F.col("_a")) * part)


def latency_report(df: DataFrame, key: str, value: str, shares: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Count, mean and exact quantiles of a latency per key, one column per quantile."""
    quantiles = _quantiles(df, key, value, shares, 10_000, {"mean": F.avg("_v")})
    return quantiles.groupBy(key, F.col("_n").alias("n"), "mean").agg(
        *[F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"p{round(s * 100)}") for s in shares]
    )


def value_histogram(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs, per group."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n"))
