"""Corpus -> chunks -> vectors -> collection -> index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektorloom.collections.store import Collections
from vektorloom.operators.chunking import chunk_id, fixed_length_chunks, recursive_chunks
from vektorloom.operators.embedding import EncoderFactory, embed
from vektorloom.operators.stored_index import StoredIndexes


def chunked(
    corpus: DataFrame, key: str, text: str, size: int = 512, overlap: int = 0, split: str = "recursive"
) -> DataFrame:
    """``doc_id, chunk_idx, chunk_id, text`` of a corpus."""
    documents = corpus.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if split == "recursive":
        chunks = recursive_chunks(documents, "text", size, overlap)
    elif split == "length":
        chunks = fixed_length_chunks(documents, "text", size, overlap)
    else:
        raise ValueError(f"unknown split {split!r}; use recursive or length")
    return chunks.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_idx")))


def embedded_chunks(chunks: DataFrame, encoder: EncoderFactory | None = None, batch_size: int = 1024) -> DataFrame:
    """Chunks with their vector. A chunk row is small, so the plan spreads by rows, not by document."""
    return embed(chunks, "text", encoder, "vector", batch_size)


def indexes_of(store: Collections) -> StoredIndexes:
    """The indexes that belong to the collections of a store."""
    return StoredIndexes(store.spark, f"{store.root}/indexes")


def ingest(
    store: Collections,
    name: str,
    corpus: DataFrame,
    key: str,
    text: str,
    dim: int,
    encoder: EncoderFactory | None = None,
    size: int = 512,
    overlap: int = 0,
    split: str = "recursive",
    index: str | None = None,
    metric: str = "l2",
    if_exists: str = "replace",
    **index_options,
):
    """Fill a collection from a corpus and optionally index it; returns the index, named after the collection.

    ``if_exists`` is replace or append.
    """
    return ingest_chunks(store, name, chunked(corpus, key, text, size, overlap, split), dim, encoder, index, metric, if_exists, **index_options)


def ingest_chunks(
    store: Collections,
    name: str,
    chunks: DataFrame,
    dim: int,
    encoder: EncoderFactory | None = None,
    index: str | None = None,
    metric: str = "l2",
    if_exists: str = "replace",
    **index_options,
):
    """Fill a collection from ``chunk_id, text`` rows of any origin (recursive chunks, chunks of parsed blocks)."""
    prepared(store, name, dim, "text", if_exists)
    rows = embedded_chunks(chunks, encoder)
    store.insert_rows(
        name,
        rows.withColumn("id", F.col("chunk_id")).withColumn("payload", F.create_map(F.lit("chunk"), F.col("text"))),
    )
    if index is None:
        return None
    return indexed(store, name, index, metric, ("id",), ("text",), **index_options)


def ingest_pages(
    store: Collections,
    name: str,
    page_vectors: DataFrame,
    dim: int,
    index: str | None = None,
    metric: str = "ip",
    if_exists: str = "replace",
    **index_options,
):
    """Fill a multi-vector collection from ``doc_id, seq_id, vector, filepath`` rows, several per page."""
    prepared(store, name, dim, "image", if_exists)
    store.insert_rows(name, page_vectors)
    if index is None:
        return None
    return indexed(store, name, index, metric, ("doc_id", "seq_id"), ("filepath",), **index_options)


def prepared(store: Collections, name: str, dim: int, data_type: str, if_exists: str) -> None:
    if if_exists not in ("replace", "append"):
        raise ValueError(f"unknown if_exists {if_exists!r}; use replace or append")
    store.create(name, dim, data_type, "replace" if if_exists == "replace" else "ignore")


def indexed(store: Collections, name: str, kind: str, metric: str, item_keys, fields, **options):
    """A new version of the collection's index over its current rows."""
    return indexes_of(store).build(
        store.scan(name), kind, metric, name.lower(), item_keys, fields, snapshot=store.snapshot(name), **options
    )
