"""Ranks, row positions and pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektorloom.session import shared_dir


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per key with a 0-based ``rank``.

    Spark cuts each input partition to ``k`` rows per key before the shuffle (WindowGroupLimit),
    so a hot key never travels whole.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        df.withColumn(rank, position.cast("long"))
        .where(F.col(rank) <= k)
        .withColumn(rank, F.col(rank) - 1)
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The row with the highest version per key."""
    newest_first = [F.col(c).desc() for c in version]
    return top_per_key(df, keys, newest_first, 1, rank="_latest").drop("_latest")


def with_row_index(df: DataFrame, order: Sequence[str], name: str = "row_idx") -> DataFrame:
    """0-based position in the global order, without a single-task window.

    The range-sorted rows are checkpointed once so that partition numbers are stable, then each
    partition's row count gives the offset of the next one.
    """
    shared_dir(df.sparkSession)
    ordered = df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint()
    per_part = ordered.groupBy(F.shiftright("_mid", 33).alias("_part")).agg(F.count("*").alias("_rows"))
    # one row per partition of the sort, so this window is as small as the partition count
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base"))
    return (
        ordered.withColumn("_part", F.shiftright("_mid", 33))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_base") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mid", "_part", "_base")
    )


def page(df: DataFrame, key: str, length: int, offset: int) -> DataFrame:
    """Page number ``offset`` of ``length`` rows in the order of ``key``.

    Rows with equal keys are ordered by their other columns, NULL keys come first. The last page is cut short; a page
    that starts past the end raises.
    """
    positions = Positions(df, key)
    if offset * length >= positions.total:
        raise ValueError(f"page {offset} of {length} rows starts past the end ({positions.total} rows)")
    return positions.rows(offset * length, (offset + 1) * length)


def head_share(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Leading ``int(total * ratio)`` rows in key order (a fixed prefix, not a random sample)."""
    positions = Positions(df, key)
    return positions.rows(0, int(positions.total * ratio))


def between_positions(df: DataFrame, key: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` in the order of ``key``; equal keys by the hash of the whole row."""
    return Positions(df, key).rows(start, stop)


class Positions:
    """Order statistics of a table: which keys stand at which positions, without moving rows.

    Only the key and a hash of the row are sorted (and written once, so that positions are stable). The keys at the two
    ends of a range of positions then become a filter on the table, whose key part reaches the file scan.
    """

    def __init__(self, df: DataFrame, key: str):
        self.df, self.key = df, key
        self.tie = F.xxhash64(*df.columns)
        self.order = with_row_index(df.select(F.col(key).alias("key"), self.tie.alias("tie")), ["key", "tie"], "position")
        self.total = self.order.count()

    def rows(self, start: int, stop: int) -> DataFrame:
        start, stop = max(0, start), min(stop, self.total)
        if start >= stop:
            return self.df.limit(0)
        at = {r.position: r for r in self.order.where(F.col("position").isin(start, stop - 1)).collect()}
        low, high = at[start], at[stop - 1]
        ends = [(low, F.min("position")), (high, F.max("position"))]
        first, last = (self.order.where(self._equal(F.col("key"), F.col("tie"), r)).agg(p).first()[0] for r, p in ends)
        key, tie = F.col(self.key), self.tie
        if first == start and last == stop - 1:
            return self._between(low, high, True)
        if (low.key, low.tie) == (high.key, high.tie):
            return self.df.where(self._equal(key, tie, low)).limit(stop - start)
        # the range begins or ends among repeated rows: as many of them as belong to it
        inner = self._between(low, high, False)
        last_low, first_high = (self.order.where(self._equal(F.col("key"), F.col("tie"), r)).agg(p).first()[0] for r, p in ((low, F.max("position")), (high, F.min("position"))))
        some_low = self.df.where(self._equal(key, tie, low)).limit(last_low - start + 1)
        return inner.unionByName(some_low).unionByName(self.df.where(self._equal(key, tie, high)).limit(stop - first_high))

    @staticmethod
    def _equal(key: Column, tie: Column, row) -> Column:
        return (key.isNull() if row.key is None else key == F.lit(row.key)) & (tie == row.tie)

    def _between(self, low, high, inclusive: bool) -> DataFrame:
        key, tie = F.col(self.key), self.tie
        after, before = (tie >= low.tie, tie <= high.tie) if inclusive else (tie > low.tie, tie < high.tie)
        if high.key is None:
            return self.df.where(key.isNull() & after & before)
        upto = (key <= F.lit(high.key)) & ((key < F.lit(high.key)) | before)
        if low.key is None:
            return self.df.where((key.isNull() & after) | upto)
        return self.df.where((key >= F.lit(low.key)) & ((key > F.lit(low.key)) | after) & upto)


def with_batch_number(df: DataFrame, index: str, size: int, name: str = "batch") -> DataFrame:
    """Batch number of a 0-based row index."""
    return df.withColumn(name, F.floor(F.col(index) / F.lit(size)).cast("long"))


def best_overall(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global order cut to ``k`` rows."""
    return df.orderBy(*order).limit(k)
