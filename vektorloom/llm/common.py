"""What the operators share: written intermediate tables, joins that survive hot keys, batches of bounded size."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorloom.session import scratch_path

#: A key with more than one in HOT_SHARE of the rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 256

#: Rows of a settled table of ids that are sent to every task; Spark's hash table of them takes some 20 MB.
MOST_SENT = 200_000

#: Rows of an Arrow batch that a Python operator holds as Python objects at once.
SLICE_ROWS = 256

#: What this Python worker keeps for later tasks: a name, and the value with what it was made of.
_KEPT: dict[str, tuple[Any, Any]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read again: computed once, and not lost with an executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_in(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``settled``, and the folder, for a table that goes (``remove_folder``) when the next one is written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


@contextmanager
def without_old_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the query that made them ends, not when the driver collects its garbage: settled tables do
    not need them any more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def sent_if_few(rows: DataFrame) -> DataFrame:
    """A settled table marked for broadcast if it has few rows; a larger one is left to a shuffled join.

    Its files tell the number, so nothing is collected to decide it.
    """
    return F.broadcast(rows) if rows.count() <= MOST_SENT else rows


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row per ``key``; ``size``: how many of the rows have it).

    Hot keys are fewer than ``HOT_SHARE``, so their groups are sent to every task; all other keys are small and are
    shuffled. Rows without a key take no part in the shuffle. Both frames are read several times and should be settled.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    with_key = rows.where(F.col(key).isNotNull())
    hot_rows = with_key.join(hot, key)
    cold_rows = with_key.join(hot.select(key), key, "left_anti").join(groups.where(~is_hot), key, "left")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in groups.schema if f.name != key]
    no_key = rows.where(F.col(key).isNull()).select("*", *none)
    return hot_rows.unionByName(cold_rows).unionByName(no_key)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Columns of short slices as Python lists."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS).to_pydict()


def kept(name: str, source: Any, make: Callable[[], Any]) -> Any:
    """``make()``, remembered by the worker process for later tasks that keep this name and have an equal source."""
    found = _KEPT.get(name)
    if found is None or found[0] != source:
        found = _KEPT[name] = source, make()
    return found[1]


def keep_only(name: str | None) -> None:
    """Free what the worker process keeps for other operators; executors use a worker for one stage after another."""
    others = [k for k in _KEPT if k != name]
    for other in others:
        del _KEPT[other]
    if others:
        gc.collect()


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str, keeps: str | None = None
) -> DataFrame:
    """Run ``make()`` once per task and the function it returns on each slice of rows. ``keeps``: the name of what ``make``
    keeps in the worker (``kept``)."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        keep_only(keeps)
        arrow, work = to_arrow_schema(fields), make()
        for columns in rows_in(batches):
            yield pa.RecordBatch.from_pydict(work(columns), schema=arrow)

    return df.mapInArrow(run, schema)


def sized_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a slice take at most ``most_bytes``; a larger text is a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of a text column; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.large_binary()).to_pylist()]
