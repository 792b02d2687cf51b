"""Exact top-k similarity between a query set and a collection.

Two ways, same rows:

* *scan* - the query matrix is small (checked before it is sent out). Each task multiplies its
  Arrow batches with the matrix and keeps its best ``k`` per query, so the shuffle carries
  ``queries x k`` rows per task and never a (query, item) pair per row.
* *grid* - both sides are large. The query vectors are written as small files to the shared folder and given to every
  executor by Spark (``addFile``), so neither the driver's memory nor a shuffle holds them. Each task reads its split of
  the collection once, in pieces of bounded size, and multiplies each piece with one query file after another. The
  collection is never moved; the shuffle carries ``k`` rows per query and piece.

NULL vectors are skipped, vectors of another length raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.collections.published import SharedFolder
from vektorloom.functions.vectors import LARGER_FIRST, arrow_matrix, check_metric, score_matrix
from vektorloom.operators.ranking import top_per_key
from vektorloom.operators.spread import send_if_small
from vektorloom.session import scratch_path

MAX_SCAN_QUERIES = 16_384
MAX_SCAN_BYTES = 64 << 20
MAX_CELLS = 4 << 20  # scores held at once in one task
ITEM_TILE_BYTES = 64 << 20
QUERY_TILE_BYTES = 4 << 20


def tile_rows(tile_bytes: int, dim: int) -> int:
    """Vectors of double components that fit a tile."""
    return max(1, tile_bytes // (8 * max(dim, 1)))


@dataclass
class QueryBlock:
    """A bounded set of query vectors, as sent to the tasks."""

    keys: pa.Table
    matrix: np.ndarray


def bounded_queries(queries: DataFrame, keys: Sequence[str], vector: str) -> QueryBlock | None:
    """The query set as a block if it is provably small, else None."""
    table = queries.select(*keys, vector).limit(MAX_SCAN_QUERIES + 1).toArrow()
    if table.num_rows > MAX_SCAN_QUERIES:
        return None
    kept, matrix = arrow_matrix(table.column(vector))
    if matrix.nbytes > MAX_SCAN_BYTES:
        return None
    return QueryBlock(table.select(list(keys)).take(pa.array(kept)), matrix)


class SentQueries:
    """A query set as the tasks see it: one block sent by the driver, or files that Spark gives to every executor."""

    def __init__(self, block=None, files: Sequence[str] = (), vector: str = "vector"):
        self.block, self.files, self.vector = block, tuple(files), vector

    @property
    def whole(self) -> bool:
        return self.block is not None

    def blocks(self) -> Iterator[QueryBlock]:
        if self.block is not None:
            yield self.block.value
            return
        import pyarrow.parquet as pq

        for file in self.files:
            table = pq.read_table(SparkFiles.get(file))
            kept, matrix = arrow_matrix(table.column(self.vector))
            if len(kept):
                yield QueryBlock(table.drop_columns([self.vector]).take(pa.array(kept)), matrix)


def sent_queries(queries: DataFrame, keys: Sequence[str], vector: str = "vector", strategy: str = "auto") -> SentQueries:
    """The query set for all tasks; ``strategy`` is auto (by size), scan (one block or an error) or grid (files).

    The files stay with the executors until the application ends.
    """
    sc = queries.sparkSession.sparkContext
    block = None if strategy == "grid" else bounded_queries(queries, keys, vector)
    if block is not None:
        return SentQueries(sc.broadcast(block))
    if strategy == "scan":
        raise ValueError("too many queries to send to every task; use the grid strategy")
    widest = queries.select(F.size(vector).alias("dim")).where(F.col(vector).isNotNull()).first()
    folder = scratch_path(queries.sparkSession, "queries")
    rows = tile_rows(QUERY_TILE_BYTES, widest.dim if widest else 1)
    queries.select(*keys, vector).write.option("maxRecordsPerFile", rows).parquet(folder)
    # file by file: a folder of a mounted disk can only be given away by a single-machine session
    files = [name for name in SharedFolder(queries.sparkSession, folder).names() if name.endswith(".parquet")]
    for name in files:
        sc.addFile(f"{folder}/{name}")
    return SentQueries(files=files, vector=vector)


def bounded_pieces(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of about ``most_bytes``."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


class BestK:
    """Running best ``k`` items per query; ties go to the smallest item key."""

    def __init__(self, k: int, larger_first: bool, digits: int | None):
        self.k, self.sign, self.digits = k, (-1.0 if larger_first else 1.0), digits
        self.query = np.empty(0, dtype=np.int64)
        self.cost = np.empty(0)
        self.items: list[np.ndarray] | None = None

    def add(self, scores: np.ndarray, query_rows: np.ndarray, items: list[np.ndarray]) -> None:
        if scores.size == 0:
            return
        values = scores if self.digits is None else np.round(scores, self.digits)
        # a NaN score (no direction) ranks nowhere
        cost = np.where(np.isnan(values), np.inf, self.sign * values)
        if cost.shape[1] > self.k:
            limit = np.partition(cost, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            keep = (cost <= limit) & np.isfinite(cost)
        else:
            keep = np.isfinite(cost)
        row, col = np.nonzero(keep)
        self._merge(query_rows[row], cost[row, col], [part[col] for part in items])

    def _merge(self, query: np.ndarray, cost: np.ndarray, items: list[np.ndarray]) -> None:
        if self.items is not None:
            query = np.concatenate([self.query, query])
            cost = np.concatenate([self.cost, cost])
            items = [np.concatenate(pair) for pair in zip(self.items, items)]
        order = np.lexsort((*reversed(items), cost, query))
        query = query[order]
        first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.empty(0, bool)
        start = np.flatnonzero(first)
        position = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        cut = position < self.k
        self.query, self.cost = query[cut], cost[order][cut]
        self.items = [part[order][cut] for part in items]

    def batch(self, query_keys: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.items is None or len(self.query) == 0:
            return
        picked = query_keys.take(pa.array(self.query))
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in picked.columns]
        columns += [pa.array(part) for part in self.items]
        columns.append(pa.array(self.sign * self.cost + 0.0))
        yield pa.RecordBatch.from_arrays(
            [c.cast(f.type) for c, f in zip(columns, schema)], schema=schema
        )


def column_values(batch, name: str, kept: np.ndarray) -> np.ndarray:
    column = batch.column(name)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.to_numpy(zero_copy_only=False)[kept]
    return values.astype(str) if values.dtype == object else values


def hit_schema(queries: DataFrame, collection: DataFrame, query_keys, item_keys) -> T.StructType:
    return T.StructType(
        [queries.schema[c] for c in query_keys]
        + [collection.schema[c] for c in item_keys]
        + [T.StructField("score", T.DoubleType())]
    )


def scan_partitions(
    items: DataFrame,
    sent: SentQueries,
    schema: T.StructType,
    item_keys: Sequence[str],
    k: int,
    larger_first: bool,
    digits: int | None,
    score_batch: Callable[[np.ndarray, pa.RecordBatch], Iterator[tuple]],
) -> DataFrame:
    """Best ``k`` per query and input partition (or, for query files, per query and piece of a partition).

    ``score_batch(query matrix, batch)`` yields (query rows, batch rows, scores) pieces.
    """

    def hits(queries: QueryBlock, batches) -> Iterator[pa.RecordBatch]:
        best = BestK(k, larger_first, digits)
        for batch in batches if len(queries.matrix) else ():
            for query_rows, rows, scores in score_batch(queries.matrix, batch):
                best.add(scores, query_rows, [column_values(batch, c, rows) for c in item_keys])
        yield from best.batch(queries.keys, to_arrow_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in [batches] if sent.whole else bounded_pieces(batches, ITEM_TILE_BYTES):
            for queries in sent.blocks():
                yield from hits(queries, piece)

    return items.mapInArrow(run, schema)


def dense_scorer(metric: str, vector: str):
    """Scores whole batches, a bounded number of cells at a time."""

    def score(matrix: np.ndarray, batch: pa.RecordBatch):
        kept, items = arrow_matrix(batch.column(vector), matrix.shape[1])
        if len(kept) == 0:
            return
        step = max(1, MAX_CELLS // len(kept))
        for low in range(0, len(matrix), step):
            rows = np.arange(low, min(low + step, len(matrix)))
            yield rows, kept, score_matrix(metric, matrix[rows], items)

    return score


def similarity_top_k(
    queries: DataFrame,
    collection: DataFrame,
    k: int,
    metric: str = "l2",
    query_keys: Sequence[str] = ("q_id",),
    item_keys: Sequence[str] = ("id",),
    query_vector: str = "vector",
    item_vector: str = "vector",
    digits: int | None = 6,
    strategy: str = "auto",
    output_fields: Sequence[str] = (),
) -> DataFrame:
    """Best ``k`` items per query: query keys, item keys, ``score``, 0-based ``rank``, output fields.

    Scores are rounded to ``digits`` before ranking and ties go to the smallest item key, so the
    order is the same on every run. A collection with fewer than ``k`` items gives fewer rows.
    The query side is read once while the plan is built, to learn whether it is small.
    """
    metric = check_metric(metric)
    schema = hit_schema(queries, collection, query_keys, item_keys)
    items = collection.select(*item_keys, item_vector)
    sent = sent_queries(queries, query_keys, query_vector, strategy)
    larger = LARGER_FIRST[metric]
    hits = scan_partitions(items, sent, schema, item_keys, k, larger, digits, dense_scorer(metric, item_vector))
    ranked = rank_hits(hits, query_keys, item_keys, k, larger)
    if not output_fields:
        return ranked
    return with_fields(ranked, collection, item_keys, output_fields, few_hits=sent.whole)


def rank_hits(hits: DataFrame, query_keys, item_keys, k: int, larger_first: bool) -> DataFrame:
    score = F.col("score").desc() if larger_first else F.col("score").asc()
    return top_per_key(hits, query_keys, [score, *[F.col(c) for c in item_keys]], k)


def cut_into_tiles(queries: DataFrame, items: DataFrame, on: str, query_keys, item_keys, dim: int):
    """Both sides with tile numbers ``_q`` and ``_c``, so that a hot value of ``on`` is split.

    Every value of ``on`` gets as many tiles per side as its rows need; each side is repeated for
    the tiles of the other one, and the pairs of tiles meet on ``(on, _q, _c)``.
    """
    def needed(side: DataFrame, tile_bytes: int, name: str) -> DataFrame:
        tiles = F.ceil(F.count("*") / F.lit(tile_rows(tile_bytes, dim))).cast("long")
        return side.groupBy(on).agg(tiles.alias(name))

    sizes = needed(items, ITEM_TILE_BYTES, "_nc").join(needed(queries, QUERY_TILE_BYTES, "_nq"), on)
    first = F.lit(0).cast("long")
    left = queries.join(sizes, on).select(
        *queries.columns,
        F.pmod(F.xxhash64(*query_keys), F.col("_nq")).alias("_q"),
        F.explode(F.sequence(first, F.col("_nc") - 1)).alias("_c"),
    )
    right = items.join(sizes, on).select(
        *items.columns,
        F.explode(F.sequence(first, F.col("_nq") - 1)).alias("_q"),
        F.pmod(F.xxhash64(*item_keys), F.col("_nc")).alias("_c"),
    )
    return left, right


def with_fields(
    hits: DataFrame, collection: DataFrame, item_keys: Sequence[str], fields: Sequence[str], few_hits: bool = False
) -> DataFrame:
    """Add output fields of the hit items; text is fetched for the final hits only.

    ``few_hits`` says that the hits come from a bounded query set (``k`` rows each): if they are few enough they are
    sent to the collection's tasks, and the collection is not shuffled.
    """
    small = send_if_small(hits) if few_hits else hits
    return collection.select(*item_keys, *fields).join(small, list(item_keys))


def rescored(
    candidates: DataFrame,
    queries: DataFrame,
    collection: DataFrame,
    k: int,
    metric: str,
    query_keys: Sequence[str] = ("q_id",),
    item_keys: Sequence[str] = ("id",),
    query_vector: str = "vector",
    item_vector: str = "vector",
    digits: int = 6,
) -> DataFrame:
    """Score an over-fetched candidate list exactly and keep ``k``."""
    metric = check_metric(metric)
    wanted = send_if_small(candidates.select(*query_keys, *item_keys))
    pairs = (
        collection.select(*item_keys, F.col(item_vector).alias("_item"))
        .join(wanted, list(item_keys))
        .join(queries.select(*query_keys, F.col(query_vector).alias("_query")), list(query_keys))
    )
    hits = pair_scores(pairs.select(*query_keys, *item_keys, "_query", "_item"), metric)
    hits = hits.select(*query_keys, *item_keys, F.round("score", digits).alias("score")).where(F.col("score").isNotNull())
    return rank_hits(hits, query_keys, item_keys, k, LARGER_FIRST[metric])


def pair_scores(pairs: DataFrame, metric: str) -> DataFrame:
    """The rows with their ``score`` in place of the vectors ``_query`` and ``_item``; NULL without a score."""
    kept = [f for f in pairs.schema.fields if f.name not in ("_query", "_item")]
    schema = T.StructType([*kept, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            both = batch.filter(pc.and_(pc.is_valid(batch.column("_query")), pc.is_valid(batch.column("_item"))))
            _, asked = arrow_matrix(both.column("_query"))
            _, items = arrow_matrix(both.column("_item"), asked.shape[1])
            if metric == "l2":
                scores = ((asked - items) ** 2).sum(axis=1)
            else:
                scores = (asked * items).sum(axis=1)
            none = np.zeros(len(scores), bool)
            if metric == "cosine":
                lengths = np.sqrt((asked**2).sum(axis=1)) * np.sqrt((items**2).sum(axis=1))
                none = lengths == 0
                scores = scores / np.where(none, 1, lengths)
            columns = [both.column(f.name) for f in kept] + [pa.array(scores, mask=none)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return pairs.mapInArrow(run, schema)


def hit_report(hits: DataFrame, text: str = "text", item_key: str = "id", query_key: str = "q_id") -> DataFrame:
    """One line per hit: query, 0-based position, item, score to 4 places, text length."""
    return hits.select(
        query_key,
        "rank",
        item_key,
        F.round("score", 4).alias("score"),
        F.length(text).cast("long").alias("text_length"),
    )


def search_batches(queries: DataFrame, index: str, size: int, total: int) -> DataFrame:
    """Micro-batch number of each query; a batch larger than the query set is cut to it."""
    step = max(1, min(size, total))
    return queries.withColumn("batch", F.floor(F.col(index) / F.lit(step)).cast("long"))
