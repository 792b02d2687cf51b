"""Stage marks and batch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorloom.functions.text import base_name, captured_int, directory_name

# Line and file-name patterns.
MARK_PATTERN = r"^(.*?),\s*(\d+)\s*$"
BATCH_FILE_PATTERN = r"^wiki_batch_(\d+)\.log"
TOKEN_LINE_PATTERN = r"Max Token Size in Batch: (\d+)"


def parse_marks(lines: DataFrame, line: str = "value") -> DataFrame:
    """``tag, ts_ns`` from mark lines; malformed lines are skipped."""
    kept = [c for c in lines.columns if c != line]
    return lines.select(
        *kept,
        F.trim(F.regexp_extract(line, MARK_PATTERN, 1)).alias("tag"),
        captured_int(F.col(line), MARK_PATTERN, 2).alias("ts_ns"),
    ).where(F.col("ts_ns").isNotNull())


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    """Stage marks of one or many runs; the run is the folder name."""
    lines = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="time_break_down.txt").select(
        base_name(directory_name(F.col("_metadata.file_path"))).alias("run"), "value"
    )
    return parse_marks(lines)


def read_token_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``batch, token_size`` of every matching line in the batch logs."""
    lines = spark.read.text(path, pathGlobFilter="wiki_batch_*.log").select(
        captured_int(F.col("_metadata.file_name"), BATCH_FILE_PATTERN).alias("batch"),
        captured_int(F.col("value"), TOKEN_LINE_PATTERN).alias("token_size"),
    )
    return lines.where(F.col("batch").isNotNull() & F.col("token_size").isNotNull())


def token_histogram(sizes: DataFrame) -> DataFrame:
    """Count per batch and token size."""
    return sizes.groupBy("batch", "token_size").agg(F.count("*").alias("n"))


def write_token_histogram(histogram: DataFrame, path: str) -> None:
    """One folder per batch with ``token_size, n`` lines in size order.

    A batch has as many lines as it has distinct sizes, so ordering them in one file is cheap.
    """
    (
        histogram.repartition("batch")
        .sortWithinPartitions("batch", "token_size")
        .write.mode("overwrite")
        .partitionBy("batch")
        .csv(path)
    )
