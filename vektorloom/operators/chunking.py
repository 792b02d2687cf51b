"""Splitting texts into chunks; document id and position are kept with every chunk."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektorloom.operators.spread import spread_small

# Split marks in order of preference; the empty mark splits between characters.
SPLIT_MARKS = ("\n\n", "\n", " ", "")


def fixed_length_chunks(df: DataFrame, text: str, size: int, overlap: int = 0, name: str = "text") -> DataFrame:
    """One row per chunk of ``size`` characters, starting every ``size - overlap``.

    The text is cut into blocks in one pass and each chunk joined from neighbouring blocks, so
    long texts cost linear time. An empty text gives one empty chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than size")
    step = size - overlap
    reach = 1 + -(-overlap // step)
    blocks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    length = F.length(text)
    chunks = F.when(
        F.size("_blocks") <= 1, F.array(F.col(text))
    ).otherwise(
        F.transform(
            F.sequence(
                F.lit(1), F.greatest(F.ceil((length - overlap) / F.lit(step)), F.lit(1)).cast("int")
            ),
            lambda i: F.substring(F.array_join(F.slice(F.col("_blocks"), i, reach), ""), 1, size),
        )
    )
    kept = [c for c in df.columns if c != text]
    return (
        spread_small(df.where(F.col(text).isNotNull()))
        .withColumn("_blocks", blocks)
        .select(*kept, F.posexplode(chunks).alias("chunk_idx", name))
        .withColumn("chunk_idx", F.col("chunk_idx").cast("long"))
    )


def split_recursively(text: str, size: int, overlap: float = 0, marks: Sequence[str] = SPLIT_MARKS) -> list[str]:
    """Chunks of at most ``size`` characters, split at the coarsest mark that fits.

    Works on spans of the text: pieces are contiguous, so a chunk is one stripped slice. Marks stay
    at the start of the piece they precede. ``overlap`` is a number of characters.
    """
    chunks: list[str] = []

    def emit(start: int, stop: int) -> None:
        chunk = text[start:stop].strip()
        if chunk:
            chunks.append(chunk)

    def merge(pieces: list[tuple[int, int]]) -> None:
        first = 0
        for number, (start, stop) in enumerate(pieces):
            held = start - pieces[first][0] if number > first else 0
            if held + stop - start > size:
                if number > first:
                    emit(pieces[first][0], start)
                while held > overlap or (held > 0 and held + stop - start > size):
                    held -= pieces[first][1] - pieces[first][0]
                    first += 1
        if first < len(pieces):
            emit(pieces[first][0], pieces[-1][1])

    def pieces_of(start: int, stop: int, mark: str) -> Iterator[tuple[int, int]]:
        if not mark:
            yield from ((i, i + 1) for i in range(start, stop))
            return
        at, found = start, text.find(mark, start, stop)
        while found >= 0:
            if found > at:
                yield at, found
            at, found = found, text.find(mark, found + len(mark), stop)
        if stop > at:
            yield at, stop

    def split(start: int, stop: int, level: int) -> None:
        while marks[level] and text.find(marks[level], start, stop) < 0 and level + 1 < len(marks):
            level += 1
        fitting: list[tuple[int, int]] = []
        for piece in pieces_of(start, stop, marks[level]):
            if piece[1] - piece[0] < size:
                fitting.append(piece)
                continue
            merge(fitting)
            fitting = []
            if level + 1 < len(marks):
                split(*piece, level + 1)
            else:
                chunks.append(text[slice(*piece)])
        merge(fitting)

    split(0, len(text), 0)
    return chunks


def recursive_chunks(df: DataFrame, text: str, size: int = 512, overlap: float = 0.1, name: str = "text") -> DataFrame:
    """One row per recursive chunk, with ``chunk_idx`` from 0. Texts without content give no row."""

    @F.pandas_udf("array<string>")
    def split_batch(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: split_recursively(t, size, overlap) if t is not None else [])

    kept = [c for c in df.columns if c != text]
    return spread_small(df).select(*kept, F.posexplode(split_batch(F.col(text))).alias("chunk_idx", name)).withColumn(
        "chunk_idx", F.col("chunk_idx").cast("long")
    )


def chunks_of_blocks(blocks: DataFrame, min_chars: int = 1) -> DataFrame:
    """Structure-aware chunks: one per text block of a parsed document, headings kept as a path."""
    body = blocks.where((F.col("kind") != "heading") & (F.length("text") >= min_chars))
    return body.select(
        "doc_id", F.col("block_idx").alias("chunk_idx"), "kind", "heading_path", "text"
    )


def chunk_totals(chunks: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return chunks.groupBy(doc_id).agg(
        F.count("*").alias("n_chunks"), F.sum(F.length(text)).cast("long").alias("n_chars")
    )


def chunk_id(doc_id: Column, chunk_idx: Column) -> Column:
    """Stable chunk name from document and position."""
    return F.concat(doc_id.cast("string"), F.lit("-"), chunk_idx.cast("string"))
