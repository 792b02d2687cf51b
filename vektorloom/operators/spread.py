"""Spreading small inputs over the cores, and sending small results to every task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of keys and scores that may be sent to every task
MAX_SENT_ROWS = 1_000_000

#: a scan split of Spark's default size, the smallest piece worth a task, and what may be shuffled for it
SPLIT_BYTES = 128 << 20
PIECE_BYTES = 256 << 10
MAX_SPREAD_BYTES = 4 << 30


def spread_small(df: DataFrame) -> DataFrame:
    """Spread rows evenly before heavy per-row work if the input fills fewer scan splits than cores.

    A small table often sits in one file and would be worked on by one task. The size is the
    optimizer's estimate (no job runs); large inputs already have enough splits and are returned
    as they are, without a shuffle, and so are tiny ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    pieces = min(cores, estimate // PIECE_BYTES + 1)
    small = estimate < min(cores * SPLIT_BYTES, MAX_SPREAD_BYTES)
    return df.repartition(int(pieces)) if small and pieces > 1 else df


def over_all_cores(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly before calls to a model, which cost far more than moving a row.

    The number of pieces is given, so adaptive execution does not put them together again.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def most_sent(df: DataFrame) -> int:
    """Rows that may be sent: a tenth where values have no fixed width."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return MAX_SENT_ROWS if all(isinstance(f.dataType, fixed) for f in df.schema) else MAX_SENT_ROWS // 10


def table_if_small(df: DataFrame) -> pa.Table | None:
    """The rows as an Arrow table if there are at most ``most_sent``, else None. They are computed here, once."""
    most = most_sent(df)
    rows = df.limit(most + 1).toArrow()
    return rows if rows.num_rows <= most else None


def kept_if_small(df: DataFrame) -> DataFrame | None:
    """The frame as a local table if it has at most ``most_sent`` rows, else None.

    For narrow results such as hit lists.
    """
    rows = table_if_small(df)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def send_if_small(df: DataFrame) -> DataFrame:
    """The frame marked for broadcast if it is small; a larger one is left to a shuffled join."""
    local = kept_if_small(df)
    return df if local is None else F.broadcast(local)
