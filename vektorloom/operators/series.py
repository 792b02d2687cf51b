"""Ordered-window operators over long series.

A series is one device, process or run, and one of them may hold a large share of all rows. So no
window here is partitioned by the series alone: rows are cut into slices of the (whole-number)
order column, windows run inside (series, slice), and one small row per slice carries over what
the next or previous slice needs. A sampled device emits a bounded number of rows per slice,
which bounds every task. Results equal the plain windows over the whole series.

NULL keys are a series of their own.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektorloom.operators.ranking import top_per_key


def _sliced(df: DataFrame, order: Sequence[str], width: int) -> DataFrame:
    return df.withColumn("_slice", F.expr(f"`{order[0]}` div {int(width)}"))


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def _across(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("_slice")


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys are equal to each other; the keys are given once."""
    renamed = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"_of_{k}"]) for k in keys))
    return left.join(renamed, same, "left").drop(*(f"_of_{k}" for k in keys))


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: dict[str, str],
    width: int,
    following: bool = False,
) -> DataFrame:
    """Add columns of the previous (or following) row: ``{source column: new column}``."""
    sliced = _sliced(df, order, width)
    packed = F.struct(*columns)
    near = (F.lead if following else F.lag)(packed).over(_inside(keys, order))
    pick = F.min_by if following else F.max_by
    edges = sliced.groupBy(*keys, "_slice").agg(pick(packed, F.struct(*order)).alias("_edge"))
    shift = F.lead if following else F.lag
    carry = edges.select(*keys, "_slice", shift("_edge").over(_across(keys)).alias("_carry"))
    joined = sliced.withColumn("_near", near).transform(beside, carry, [*keys, "_slice"])
    near_row = F.coalesce("_near", "_carry")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[near_row.getField(source).alias(name) for source, name in columns.items()],
    )


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], width: int
) -> DataFrame:
    """Sums from the first row of the series up to and including each row: ``{new column: value}``."""
    names = list(values)
    sliced = _sliced(df, order, width).withColumns({f"_v_{n}": v for n, v in values.items()})
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sliced.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in names])
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_slice", *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in names])
    local = sliced.withColumns({f"_p_{n}": F.sum(f"_v_{n}").over(upto) for n in names})
    joined = local.transform(beside, carry, [*keys, "_slice"])
    totals = [
        F.coalesce(F.col(f"_c_{n}") + F.col(f"_p_{n}"), f"_p_{n}", f"_c_{n}").alias(n) for n in names
    ]
    return joined.select(*[F.col(c) for c in df.columns], *totals)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, width: int, name: str
) -> DataFrame:
    """One running sum, see :func:`running_sums`."""
    return running_sums(df, keys, order, {name: value}, width)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int, name: str
) -> DataFrame:
    """Latest non-NULL ``value`` at or before each row."""
    sliced = _sliced(df, order, width)
    upto = _inside(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.when(F.col(value).isNotNull(), F.struct(*order))
    edges = sliced.groupBy(*keys, "_slice").agg(F.max_by(value, seen).alias("_edge"))
    before = _across(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = edges.select(*keys, "_slice", F.last("_edge", ignorenulls=True).over(before).alias("_carry"))
    joined = sliced.withColumn("_local", F.last(value, ignorenulls=True).over(upto)).transform(
        beside, carry, [*keys, "_slice"]
    )
    return joined.select(*[F.col(c) for c in df.columns], F.coalesce("_local", "_carry").alias(name))


def centred_mean(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    width: int,
    name: str,
    points: int = 5,
) -> DataFrame:
    """Moving average over ``points`` rows around each row; missing neighbours count as 0."""
    half = points // 2
    inside = _inside(keys, order)
    base = _sliced(df, order, width).withColumn("_x", F.coalesce(F.col(value).cast("double"), F.lit(0.0)))
    local = (
        base.withColumn("_near", F.sum("_x").over(inside.rowsBetween(-half, half)))
        .withColumn("_pos", F.row_number().over(inside))
        .withColumn("_left", F.count("*").over(Window.partitionBy(*keys, "_slice")) - F.col("_pos"))
    )

    def border(newest: bool, name: str) -> DataFrame:
        """First or last ``half`` values of each slice, cut inside every task before the shuffle."""
        by = [F.col(c).desc() if newest else F.col(c).asc() for c in order]
        few = top_per_key(base.select(*keys, "_slice", *order, "_x"), [*keys, "_slice"], by, half, "_n")
        place = -F.col("_n") if newest else F.col("_n")
        return few.groupBy(*keys, "_slice").agg(
            F.array_sort(F.collect_list(F.struct(place.alias("_n"), "_x"))).getField("_x").alias(name)
        )

    borders = beside(border(False, "_head"), border(True, "_tail"), [*keys, "_slice"])
    # every slice in `borders` has at least one row, so `half` slices hold `half` neighbours
    across = _across(keys)
    carry = borders.select(
        *keys,
        "_slice",
        F.flatten(F.collect_list("_tail").over(across.rowsBetween(-half, -1))).alias("_before"),
        F.flatten(F.collect_list("_head").over(across.rowsBetween(1, half))).alias("_after"),
    )
    joined = local.transform(beside, carry, [*keys, "_slice"])
    missing_before = f"({half} - _pos + 1)"
    missing_after = f"({half} - _left)"
    before = F.expr(
        f"CASE WHEN _pos <= {half} THEN aggregate(slice(_before, "
        f"greatest(size(_before) - {missing_before} + 1, 1), CAST({missing_before} AS INT)), "
        "0D, (t, x) -> t + x) ELSE 0D END"
    )
    after = F.expr(
        f"CASE WHEN _left < {half} THEN aggregate(slice(_after, 1, CAST({missing_after} AS INT)), "
        "0D, (t, x) -> t + x) ELSE 0D END"
    )
    mean = (F.col("_near") + F.coalesce(before, F.lit(0.0)) + F.coalesce(after, F.lit(0.0))) / points
    return joined.select(*[F.col(c) for c in df.columns], mean.alias(name))


def gap_sessions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: int, width: int
) -> DataFrame:
    """Sessions of rows at most ``gap`` apart: first and last time and row count of each."""
    at = order[0]
    near = with_neighbour(df, keys, order, {at: "_before"}, width)
    opens = F.when(F.col("_before").isNull() | (F.col(at) - F.col("_before") > gap), 1).otherwise(0)
    numbered = running_sum(near, keys, order, opens.cast("long"), width, "session_no")
    return numbered.groupBy(*keys, "session_no").agg(
        F.min(at).alias("session_start"),
        F.max(at).alias("session_last"),
        F.count("*").alias("n_rows"),
    )
