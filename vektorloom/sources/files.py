"""Directory listings and run folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorloom.functions.text import base_name, directory_name
from vektorloom.functions.units import run_started_at

# File-name prefixes of the meters.
METER_PREFIXES = {
    "cpu": "CPUMeter",
    "gpu": "GPUMeter",
    "disk": "DiskMeter",
    "mem": "MemMeter",
    "proc": "ProcMeter",
}


def list_files(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """``path, name, folder, length`` of matching files, without reading their bytes."""
    found = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    return found.select(
        "path",
        base_name(F.col("path")).alias("name"),
        base_name(directory_name(F.col("path"))).alias("folder"),
        "length",
    )


def list_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """PDF files of a folder in name order."""
    return list_files(spark, path, "*.pdf", recursive=False).orderBy("name")


def not_yet_fetched(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Items without a stored file."""
    return wanted.join(present.select(key), key, "left_anti")


def runs_by_age(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Run folders newest first, from the start time in their name; other folders are left out."""
    runs = files.select(folder).distinct().withColumn("started", run_started_at(F.col(folder)))
    return runs.where(F.col("started").isNotNull()).orderBy(F.col("started").desc(), folder)


def latest_run(files: DataFrame, folder: str = "folder") -> DataFrame:
    """Folder of the newest run, one row."""
    return runs_by_age(files, folder).limit(1)


def meter_of(name: Column) -> Column:
    """Meter kind from a file name; NULL for other files."""
    kinds = F.coalesce(
        *[F.when(name.startswith(prefix), F.lit(kind)) for kind, prefix in METER_PREFIXES.items()]
    )
    return kinds


def meter_pattern(meter: str) -> str:
    """Glob of a meter's metric files."""
    return f"{METER_PREFIXES[meter]}*.pb.bin"
