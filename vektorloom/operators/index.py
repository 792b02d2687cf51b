"""Approximate search: coarse cells, compressed codes, and their recall-preserving plans.

Cells prune the scan, codes shrink the vectors that are scored; the exact vectors of the over-fetched candidates are
fetched last. ``stored_index`` puts both together in tables that outlive the session.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.functions.vectors import LARGER_FIRST, arrow_matrix, check_metric, score_matrix
from vektorloom.operators.search import MAX_CELLS, hit_schema, rank_hits, rescored, scan_partitions, sent_queries

# Index kinds, and the training defaults.
INDEX_KINDS = ("IVF_FLAT", "IVF_PQ", "IVF_HNSW_SQ", "IVF_HNSW_PQ", "GPU_IVF_FLAT")
PARTITIONS = 256
ITERATIONS = 50
SAMPLE_RATE = 256
SUB_VECTORS = 96
CODE_BITS = 8

HELD_DISTANCES = 1 << 18  # to centres, held at once while rows are coded


def index_label(kind: str, metric: str) -> str:
    """Default index name."""
    return f"{kind}_{metric}"


def coding_of(kind: str) -> str | None:
    """Which compressed code an index kind stores. The graph part of a kind is left to the cells."""
    if kind not in INDEX_KINDS:
        raise ValueError(f"unknown index kind {kind!r}; use one of {INDEX_KINDS}")
    return "pq" if kind.endswith("PQ") else "sq" if kind.endswith("SQ") else None


def training_rows(df: DataFrame, rows: int, seed: int = 7) -> DataFrame:
    """About ``rows`` random rows for training codebooks, spread as the table is; the table itself is never cut."""
    total = df.count()
    return df if total <= rows else df.sample(fraction=rows / total, seed=seed)


# ---- cells ------------------------------------------------------------------


@dataclass
class Cells:
    """Coarse centroids; ``cells x dim`` numbers, independent of the table size."""

    centroids: np.ndarray
    metric: str

    @classmethod
    def train(
        cls,
        collection: DataFrame,
        metric: str = "l2",
        cells: int = PARTITIONS,
        iterations: int = ITERATIONS,
        vector: str = "vector",
        seed: int = 7,
        sample_rate: int = SAMPLE_RATE,
    ) -> Cells:
        """Fit the centroids on about ``cells * sample_rate`` rows (on all if there are fewer); every row gets a cell."""
        sample = training_rows(collection.select(vector).where(F.col(vector).isNotNull()), cells * sample_rate, seed)
        features = sample.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
        model = KMeans(k=cells, maxIter=iterations, seed=seed).fit(features)
        return cls(np.array(model.clusterCenters()), check_metric(metric))

    def nearest(self, matrix: np.ndarray, count: int) -> np.ndarray:
        costs = score_matrix("l2", matrix, self.centroids)
        if self.metric != "l2":
            costs = np.nan_to_num(-score_matrix(self.metric, matrix, self.centroids), nan=0.0)
        return np.argsort(costs, axis=1, kind="stable")[:, :count]

    def assign(self, df: DataFrame, vector: str = "vector") -> DataFrame:
        """Add the ``cell`` of every vector (always the closest centroid). NULL vectors are left out."""
        schema = T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())])
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            for batch in batches:
                kept, matrix = arrow_matrix(batch.column(vector), centroids.shape[1])
                cell = score_matrix("l2", matrix, centroids).argmin(axis=1).astype(np.int32)
                part = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell)], schema=out)

        return df.mapInArrow(run, schema)

    def probes(self, queries: DataFrame, nprobe: int, vector: str = "vector") -> DataFrame:
        """Queries repeated for each of their ``nprobe`` best cells."""
        schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType())])
        nearest = self.nearest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            for batch in batches:
                kept, matrix = arrow_matrix(batch.column(vector))
                if not len(kept):
                    continue
                cells = nearest(matrix, nprobe).astype(np.int32)
                part = batch.take(pa.array(np.repeat(kept, cells.shape[1])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells.ravel())], schema=out)

        return queries.mapInArrow(run, schema)


def probe_top_k(
    queries: DataFrame,
    indexed: DataFrame,
    cells: Cells,
    k: int,
    nprobe: int = 1,
    query_keys: Sequence[str] = ("q_id",),
    item_keys: Sequence[str] = ("id",),
    vector: str = "vector",
    digits: int | None = 6,
    strategy: str = "auto",
) -> DataFrame:
    """Best ``k`` items among the ``nprobe`` best cells of each query.

    ``indexed`` is the collection with its ``cell``. With all cells probed this equals exact search.
    """
    metric = cells.metric
    schema = hit_schema(queries, indexed, query_keys, item_keys)
    sent = sent_queries(queries, query_keys, vector, strategy)
    items = indexed.select(*item_keys, vector, "cell")
    if sent.whole:  # few queries ask for few cells
        probed = cells.nearest(sent.block.value.matrix.reshape(-1, cells.centroids.shape[1]), nprobe)
        items = items.where(F.col("cell").isin(np.unique(probed).tolist()))
    hits = scan_partitions(
        items, sent, schema, item_keys, k, LARGER_FIRST[metric], digits, _cell_scorer(cells, nprobe, vector)
    )
    return rank_hits(hits, query_keys, item_keys, k, LARGER_FIRST[metric])


def _cell_scorer(cells: Cells, nprobe: int, vector: str):
    """Multiply each cell's rows with the queries that probe it."""
    last: list = [None, None]

    def probed_by(matrix: np.ndarray) -> np.ndarray:
        if last[0] is not matrix:
            last[:] = matrix, cells.nearest(matrix, nprobe)
        return last[1]

    def score(matrix: np.ndarray, batch: pa.RecordBatch):
        kept, items = arrow_matrix(batch.column(vector), matrix.shape[1])
        cell = batch.column("cell").to_numpy(zero_copy_only=False)[kept]
        probed = probed_by(matrix)
        for number in np.unique(cell):
            members = np.flatnonzero(cell == number)
            asking = np.flatnonzero((probed == number).any(axis=1))
            step = max(1, MAX_CELLS // len(members))
            for low in range(0, len(asking), step):
                rows = asking[low : low + step]
                yield rows, kept[members], score_matrix(cells.metric, matrix[rows], items[members])

    return score


# ---- scalar codes -----------------------------------------------------------


@dataclass
class ScalarCodes:
    """Per-dimension value range; a component becomes one byte."""

    low: np.ndarray
    high: np.ndarray

    @classmethod
    def train(cls, df: DataFrame, vector: str = "vector") -> ScalarCodes:
        """Exact ranges over the whole table: each task reports one row per dimension."""
        schema = T.StructType(
            [
                T.StructField("dim", T.IntegerType()),
                T.StructField("low", T.DoubleType()),
                T.StructField("high", T.DoubleType()),
            ]
        )

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = high = None
            for batch in batches:
                kept, matrix = arrow_matrix(batch.column(vector))
                if len(kept):
                    low = matrix.min(axis=0) if low is None else np.minimum(low, matrix.min(axis=0))
                    high = matrix.max(axis=0) if high is None else np.maximum(high, matrix.max(axis=0))
            if low is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)],
                    names=["dim", "low", "high"],
                )

        per_task = df.select(vector).mapInArrow(ranges, schema)
        rows = per_task.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        rows = rows.orderBy("dim").collect()  # one row per dimension
        return cls(np.array([r.low for r in rows]), np.array([r.high for r in rows]))

    def encode(self, df: DataFrame, vector: str = "vector", name: str = "codes") -> DataFrame:
        """Replace vectors by ``array<smallint>`` codes from 0 to 255."""
        low, span = self.low, self.high - self.low

        def codes_of(matrix: np.ndarray) -> np.ndarray:
            share = np.divide(matrix - low, span, out=np.zeros_like(matrix), where=span > 0)
            return np.clip(np.floor(share * 255 + 0.5), 0, 255).astype(np.int16)

        return _with_codes(df, vector, name, codes_of)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + codes / 255.0 * (self.high - self.low)


# ---- product codes ----------------------------------------------------------


@dataclass
class ProductCodes:
    """Codebooks per sub-vector: ``[sub-vector][code] -> centre``."""

    books: list[np.ndarray]

    @classmethod
    def train(
        cls,
        df: DataFrame,
        sub_vectors: int,
        vector: str = "vector",
        bits: int = CODE_BITS,
        iterations: int = 15,
        seed: int = 7,
        sample_rate: int = SAMPLE_RATE,
    ) -> ProductCodes:
        """Train all codebooks in one job, one group per sub-vector.

        They are fitted on about ``2**bits * sample_rate`` rows (on all if there are fewer), and a group holds one
        slice of each; every row is encoded. ``sub_vectors`` must divide the dimension.
        """
        codes = 2**bits
        first = df.select(F.size(vector)).where(F.col(vector).isNotNull()).first()
        if first and first[0] % sub_vectors:
            raise ValueError(f"{sub_vectors} sub-vectors do not divide {first[0]} dimensions")
        sample = training_rows(df.select(vector).where(F.col(vector).isNotNull()), codes * sample_rate, seed)
        width = F.size(vector) / F.lit(sub_vectors)
        pieces = sample.select(
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), F.lit(sub_vectors - 1)),
                    lambda i: F.slice(F.col(vector), (i * width + 1).cast("int"), width.cast("int")),
                )
            ).alias("part", "piece")
        )
        schema = "part int, code int, centre array<double>"

        def cluster(table: pa.Table) -> pa.Table:
            _, rows = arrow_matrix(table.column("piece"))
            part = table.column("part")[0].as_py()
            centres = lloyd(rows, codes, iterations, seed + part)
            return pa.table(
                {
                    "part": pa.array([part] * len(centres), pa.int32()),
                    "code": pa.array(range(len(centres)), pa.int32()),
                    "centre": pa.array(centres.tolist(), pa.list_(pa.float64())),
                }
            )

        books: dict[int, list] = {}
        for row in pieces.groupBy("part").applyInArrow(cluster, schema).orderBy("part", "code").collect():
            books.setdefault(row.part, []).append(row.centre)
        return cls([np.array(books[p]) for p in sorted(books)])

    def encode(self, df: DataFrame, vector: str = "vector", name: str = "codes") -> DataFrame:
        books = self.books

        def codes_of(matrix: np.ndarray) -> np.ndarray:
            pieces = np.split(matrix, len(books), axis=1)
            nearest = [nearest_centres(p, b) for p, b in zip(pieces, books)]
            return np.stack(nearest, axis=1).astype(np.int16)

        return _with_codes(df, vector, name, codes_of)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)


def nearest_centres(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The closest centre of each row, a bounded number of distances at a time."""
    step = max(1, HELD_DISTANCES // len(centres))
    parts = [score_matrix("l2", rows[low : low + step], centres).argmin(axis=1) for low in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def lloyd(rows: np.ndarray, codes: int, iterations: int, seed: int) -> np.ndarray:
    """Plain k-means on a bounded sample; empty centres keep their place."""
    draw = np.random.default_rng(seed)
    distinct = np.unique(rows, axis=0)
    if len(distinct) <= codes:
        return distinct
    centres = distinct[draw.choice(len(distinct), codes, replace=False)]
    del distinct
    for _ in range(iterations):
        nearest = nearest_centres(rows, centres)
        counts = np.bincount(nearest, minlength=codes)
        sums = np.stack([np.bincount(nearest, weights=rows[:, d], minlength=codes) for d in range(rows.shape[1])], 1)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _with_codes(df: DataFrame, vector: str, name: str, codes_of) -> DataFrame:
    kept_columns = [f for f in df.schema.fields if f.name != vector]
    schema = T.StructType([*kept_columns, T.StructField(name, T.ArrayType(T.ShortType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            kept, matrix = arrow_matrix(batch.column(vector))
            if not len(kept):
                continue
            codes = codes_of(matrix)
            offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))
            part = batch.take(pa.array(kept))
            rest = [part.column(f.name) for f in kept_columns]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*rest, column], out)], schema=out
            )

    return df.mapInArrow(run, schema)


def coded_top_k(
    queries: DataFrame,
    coded: DataFrame,
    codes: ScalarCodes | ProductCodes,
    collection: DataFrame,
    k: int,
    metric: str = "l2",
    over_fetch: int = 10,
    query_keys: Sequence[str] = ("q_id",),
    item_keys: Sequence[str] = ("id",),
    vector: str = "vector",
    code: str = "codes",
) -> DataFrame:
    """Score compressed codes, keep ``over_fetch * k`` candidates, score those exactly, keep ``k``.

    The codes are read once, whatever the number of queries.
    """
    metric = check_metric(metric)
    sent = sent_queries(queries, query_keys, vector)
    schema = hit_schema(queries, coded, query_keys, item_keys)

    def score(matrix: np.ndarray, batch: pa.RecordBatch):
        kept, raw = arrow_matrix(batch.column(code))
        if not len(kept):
            return
        items = codes.decode(raw.astype(np.int64))
        step = max(1, MAX_CELLS // len(kept))
        for low in range(0, len(matrix), step):
            rows = np.arange(low, min(low + step, len(matrix)))
            yield rows, kept, score_matrix(metric, matrix[rows], items)

    larger = LARGER_FIRST[metric]
    hits = scan_partitions(coded.select(*item_keys, code), sent, schema, item_keys, k * over_fetch, larger, None, score)
    candidates = rank_hits(hits, query_keys, item_keys, k * over_fetch, larger)
    return rescored(candidates, queries, collection, k, metric, query_keys, item_keys, vector, vector)
