"""Metric files: repeated (8-byte little-endian length, protobuf message), read as DataFrames.

The bytes come through Spark's own readers, so any store that Spark can reach will do. There is no reader for parts of
binary files, but the text reader splits large files and hands on every byte between two line ends unchanged. So files
are read as lines (by all tasks), put together again in the order of their splits and lines, cut into messages as a
stream that holds one message at a time, and the messages are dealt out over all cores to be decoded: a single large
file keeps one task busy with cutting, which only looks at lengths, and all of them with reading and decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.operators.spread import over_all_cores
from vektorloom.sources.files import meter_pattern
from vektorloom.sources.messages import GPM_NAMES, METADATA, METERS, decode_message, spark_fields, wire_fields

ROWS_PER_BATCH = 256
#: Bytes of a file that travel as one row.
PIECE_BYTES = 1 << 20

#: The text reader drops these bytes at the start of a file.
MARK = b"\xef\xbb\xbf"


def file_pieces(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """The bytes of all matching files: ``path, size, split, piece, data`` (in order of the last but one two)."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("lineSep", "\n")
    known = F.col("_metadata")
    lines = reader.text(path).select(
        known.getField("file_path").alias("path"),
        known.getField("file_size").alias("size"),
        known.getField("file_block_start").alias("split"),
        F.col("value").cast("binary").alias("data"),
    )

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at, piece, size = None, 0, 0

        def row() -> pa.RecordBatch:
            columns = [pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([at[2]], pa.int64()), pa.array([piece], pa.int64())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([b"".join(held)], pa.binary())], names=["path", "size", "split", "piece", "data"])

        for batch in batches:
            for *here, data in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "split", "data"))):
                if here != at or size >= PIECE_BYTES:
                    if held:
                        yield row()
                    piece, held, size = (piece + 1 if here == at else 0), [], 0
                    at = here
                held += [data, b"\n"]
                size += len(data) + 1
        if held:
            yield row()

    return lines.mapInArrow(glue, "path string, size bigint, split bigint, piece bigint, data binary")


def whole_stream(pieces: Iterator[bytes], size: int) -> Iterator[bytes]:
    """The file's bytes from what the text reader has left of them: the last line may have had no end, and the first
    bytes may have been taken for a byte order mark (then the first length makes no sense without them)."""
    first = next(pieces, b"")
    while len(first) < 8 and (more := next(pieces, None)) is not None:
        first += more
    fits = lambda head: int.from_bytes(head[:8], "little") <= size - 8
    if not fits(first) and fits(MARK + first):
        first = MARK + first
    left = size
    for data in (x for part in ([first], pieces) for x in part):
        yield data[:left]
        left -= len(data[:left])


def cut(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Messages of a framed file. A cut-off length or body raises."""
    held = bytearray()

    def filled(count: int) -> bool:
        while len(held) < count and (more := next(stream, None)) is not None:
            held.extend(more)
        return len(held) >= count

    while filled(1):
        if not filled(8):
            raise EOFError(f"file ends inside a message length ({len(held)} of 8 bytes)")
        size = int.from_bytes(held[:8], "little")
        if not filled(8 + size):
            raise EOFError(f"expected a message of {size} bytes, got {len(held) - 8}")
        yield bytes(held[8 : 8 + size])
        del held[: 8 + size]


def read_frames(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, frame, first, body`` of all messages: number in the file, number of the first sample, bytes."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, s, d) for b in batches for p, s, d in zip(*(b.column(c).to_pylist() for c in ("path", "size", "data"))))
        ahead = next(rows, None)
        while ahead is not None:
            name, size = ahead[:2]

            def own() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and ahead[0] == name:
                    yield ahead[2]
                    ahead = next(rows, None)

            pieces, first = own(), 0
            for frame, body in enumerate(cut(whole_stream(pieces, size))):
                columns = [pa.array([name]), pa.array([frame], pa.int64()), pa.array([first], pa.int64()), pa.array([body], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "frame", "first", "body"])
                first += count_samples(body)
            for _ in pieces:  # a file that ends in empty messages
                pass

    ordered = file_pieces(spark, path, pattern).repartition("path").sortWithinPartitions("path", "split", "piece")
    return ordered.mapInArrow(walk, "path string, frame bigint, first bigint, body binary")


def count_samples(body: bytes) -> int:
    """Samples of a message, without decoding them; of a broken one (which the decoder refuses) those before the break."""
    count = 0
    try:
        for number, _, _ in wire_fields(body):
            count += number == 1
    except (ValueError, EOFError, IndexError):
        pass
    return count


def chosen(fields: dict, parent: str | None, groups: list[str] | None) -> dict:
    """A field table in which ``parent`` has only some of its groups; the others are skipped as bytes."""
    if groups is None:
        return fields
    inner = {spec[0]: (number, spec) for number, spec in fields.items()}
    if parent not in inner:
        raise ValueError(f"unknown part {parent!r}; use one of {sorted(inner)}")
    number, spec = inner[parent]
    known = {s[0]: n for n, s in spec[2].items()}
    if unknown := set(groups) - set(known):
        raise ValueError(f"unknown probes {sorted(unknown)}; use some of {sorted(known)}")
    return {**fields, number: (*spec[:2], {n: s for n, s in spec[2].items() if s[0] in groups})}


def read_metrics(spark: SparkSession, path: str, meter: str, parent: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """All samples of one meter below a folder: ``run, file, sample_idx`` and the message fields.

    With ``groups`` only these groups of the message ``parent`` are decoded.
    """
    if meter not in METERS:
        raise ValueError(f"unknown meter {meter!r}; use one of {sorted(METERS)}")
    fields = chosen(METERS[meter], parent, groups)
    head = [T.StructField("run", T.StringType()), T.StructField("file", T.StringType()), T.StructField("sample_idx", T.LongType())]
    schema = T.StructType(head + spark_fields(fields).fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for name, first, body in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "body"))):
                run, file = ("/" + unquote(name)).split("/")[-2:]
                samples = (sample for number, _, sample in wire_fields(body) if number == 1)
                rows: list[dict] = []
                for position, sample in enumerate(samples, first):
                    rows.append({"run": run, "file": file, "sample_idx": position, **decode_message(sample, fields)})
                    if len(rows) >= ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=out)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return over_all_cores(read_frames(spark, path, meter_pattern(meter))).mapInArrow(decode, schema)


def read_metadata(spark: SparkSession, path: str, meter: str, pattern: str) -> DataFrame:
    """The first message of each matching file, which names devices, probes or processes: ``run, file`` and its fields."""
    if meter not in METADATA:
        raise ValueError(f"no metadata for meter {meter!r}; use one of {sorted(METADATA)}")
    fields = METADATA[meter]
    head = [T.StructField("run", T.StringType()), T.StructField("file", T.StringType())]
    schema = T.StructType(head + spark_fields(fields).fields)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for name, body in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist()):
                run, file = ("/" + unquote(name)).split("/")[-2:]
                yield pa.RecordBatch.from_pylist([{"run": run, "file": file, **decode_message(body, fields)}], schema=out)

    return read_frames(spark, path, pattern).where("frame = 0").mapInArrow(decode, schema)


def cpu_total(samples: DataFrame) -> DataFrame:
    """Counters over all cores: the first core entry of each sample."""
    return samples.select("run", "sample_idx", F.col("timestamp").alias("ts_ns"), F.col("core_stats")[0].alias("core")).select(
        "run", "sample_idx", "ts_ns", "core.*"
    )


def per_device(samples: DataFrame, devices: str, position: str) -> DataFrame:
    """One row per sample and device position."""
    exploded = samples.select(
        "run", "sample_idx", F.col("timestamp").alias("ts_ns"), F.posexplode(devices).alias(position, "_d")
    )
    return exploded.select("run", "sample_idx", "ts_ns", F.col(position).cast("long").alias(position), "_d.*")


def probe_groups(samples: DataFrame, parent: str, groups: list[str]) -> DataFrame:
    """Only the chosen column groups of a sample, e.g. some memory probes."""
    known = set(samples.schema[parent].dataType.names)
    if unknown := set(groups) - known:
        raise ValueError(f"unknown probes {sorted(unknown)}; use some of {sorted(known)}")
    return samples.select("run", "sample_idx", *[F.col(f"{parent}.{g}").alias(g) for g in groups])


def memory_gib(samples: DataFrame, period: float = 0.1) -> DataFrame:
    """Free, available, buffered and cached memory in GiB; time from position and period."""
    info = F.col("meminfo_metrics")
    gib = F.lit(1024.0 * 1024.0)
    return samples.select(
        "run",
        "sample_idx",
        (F.col("sample_idx") * period).alias("seconds"),
        (info["basic_metrics"]["mem_free"] / gib).alias("free_gib"),
        (info["basic_metrics"]["mem_available"] / gib).alias("available_gib"),
        (info["kernel_cache_metrics"]["buffers"] / gib).alias("buffers_gib"),
        (info["kernel_cache_metrics"]["cached"] / gib).alias("cached_gib"),
    )


def gpm_names(spark: SparkSession, requested: list[int]) -> DataFrame:
    """``position, metric`` of the requested GPU metrics, for a dimension join."""
    rows = [(i, GPM_NAMES.get(number, f"GPM_{number}")) for i, number in enumerate(requested)]
    return spark.createDataFrame(rows, "position long, metric string")
