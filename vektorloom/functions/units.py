"""Clock and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GIB = 1024.0**3


def ns_to_s(ns: Column) -> Column:
    return ns / F.lit(1e9)


def bytes_to_gib(n: Column) -> Column:
    return n / F.lit(GIB)


def kb_to_gib(n: Column) -> Column:
    return n / F.lit(1024.0 * 1024.0)


def sectors_to_mb(n: Column) -> Column:
    """512-byte sectors -> MB."""
    return n * F.lit(0.5) / F.lit(1024.0)


def batch_count(rows: Column, batch: int) -> Column:
    return F.ceil(rows / F.lit(batch))


def head_count(rows: Column, ratio: float) -> Column:
    """Rows in the leading share of a table, rounded down."""
    return F.floor(rows * F.lit(ratio))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60
    micros = (F.date_part(F.lit("SECONDS"), ts) * 1000000).cast("long")
    return (days * 86400 + seconds) * 1000000 + micros


def run_started_at(folder: Column) -> Column:
    """Start time in a run folder's name, such as ``2025-10-18T18:43:27-0500``; NULL for others."""
    return F.try_to_timestamp(folder, F.lit("yyyy-MM-dd'T'HH:mm:ssxx"))
