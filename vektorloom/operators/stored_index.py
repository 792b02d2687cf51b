"""Indexes that outlive their session: built once, opened from a path, searched with codes and certified bounds.

An index is a folder. ``manifest-<number>.json`` names the files of one version and everything a search needs to know;
it appears at once when the version is complete, and the highest number is the current one. A version's rows are a
parquet table in folders per cell (keys, the vector, its code, the error of the code), its models a small parquet table.
Nothing that a manifest names is ever rewritten, so a search that has opened a version finishes on it.

A search reads codes only, and of the probed cells only. A code's reconstruction is off by ``error`` (a row's own
distance to what its code says, rounded up), so the triangle inequality bounds the true score from both sides. Each
task keeps the ``k`` best upper bounds per query and passes on every row whose lower bound reaches them; of these the
rows that reach the best bounds of all tasks are scored with their vectors. That is the exact answer for the probed
cells: no over-fetch factor, no row lost. ``over_fetch`` takes a fixed number of candidates instead.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.collections.published import SharedFolder
from vektorloom.functions.vectors import LARGER_FIRST, arrow_matrix, check_metric, score_matrix
from vektorloom.operators.index import (
    CODE_BITS,
    ITERATIONS,
    PARTITIONS,
    SAMPLE_RATE,
    SUB_VECTORS,
    Cells,
    ProductCodes,
    ScalarCodes,
    coding_of,
    index_label,
    training_rows,
)
from vektorloom.operators.ranking import top_per_key
from vektorloom.operators.search import (
    ITEM_TILE_BYTES,
    MAX_CELLS,
    bounded_pieces,
    column_values,
    rescored,
    sent_queries,
    similarity_top_k,
    with_fields,
)
from vektorloom.operators.spread import send_if_small
from vektorloom.session import remove_folder, scratch_path, shared_dir

#: Scores are rounded to so many places before they are ranked; bounds must not cut rows that tie after rounding.
DIGITS = 6
#: Rows of the collection that ask for their neighbours to measure recall, and the recall the default probing must have.
RECALL_ROWS, RECALL_AT, WANTED_RECALL = 200, 10, 0.97
MANIFEST = "manifest-"


@dataclass(frozen=True)
class Manifest:
    """What one version of an index is made of."""

    name: str
    kind: str
    metric: str
    dim: int
    cells: int
    coding: str
    item_keys: list[str]
    fields: list[str]
    vector: str
    rows: int
    snapshot: str | None
    folder: str
    nprobe: int = 1
    recall: dict[str, float] = field(default_factory=dict)
    version: int = 0


# ---- models -----------------------------------------------------------------


@dataclass
class Coder:
    """Residual codes: what is left of a vector after its cell's centroid is taken away, in bytes."""

    cells: Cells
    codes: ScalarCodes | ProductCodes | None

    @property
    def centroids(self) -> np.ndarray:
        return self.cells.centroids

    def encode(self, matrix: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = matrix - self.centroids[cell]
        if isinstance(self.codes, ScalarCodes):
            low, span = self.codes.low, self.codes.high - self.codes.low
            share = np.divide(rest - low, span, out=np.zeros_like(rest), where=span > 0)
            return np.clip(np.floor(share * 255 + 0.5), 0, 255).astype(np.uint8)
        pieces = np.split(rest, len(self.codes.books), axis=1)
        nearest = [score_matrix("l2", p, b).argmin(axis=1) for p, b in zip(pieces, self.codes.books)]
        return np.stack(nearest, axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return self.centroids[cell] + self.codes.decode(codes)

    def costs(self, queries: np.ndarray, codes: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances, or negative inner products, of the queries and the coded rows of one cell.

        Product codes are summed up from a table per sub-vector, scalar codes are decoded.
        """
        l2 = self.cells.metric == "l2"
        if isinstance(self.codes, ScalarCodes):
            items = self.decode(codes, np.full(len(codes), cell))
            return score_matrix("l2", queries, items) if l2 else -score_matrix("ip", queries, items)
        asked = queries - self.centroids[cell] if l2 else queries
        total = np.zeros((len(queries), len(codes)))
        for part, (piece, book) in enumerate(zip(np.split(asked, len(self.codes.books), axis=1), self.codes.books)):
            table = score_matrix("l2", piece, book) if l2 else -score_matrix("ip", piece, book)
            total += table[:, codes[:, part]]
        return total if l2 else total - (queries @ self.centroids[cell])[:, None]

    def table(self) -> list[tuple[str, int, list[float]]]:
        rows = [("cell", i, c.tolist()) for i, c in enumerate(self.centroids)]
        if isinstance(self.codes, ScalarCodes):
            rows += [("low", 0, self.codes.low.tolist()), ("high", 0, self.codes.high.tolist())]
        elif self.codes is not None:
            rows += [(f"book {p}", i, c.tolist()) for p, book in enumerate(self.codes.books) for i, c in enumerate(book)]
        return rows

    @classmethod
    def of_table(cls, rows: list, metric: str) -> Coder:
        parts: dict[str, list] = {}
        for row in sorted(rows, key=lambda r: (r.part, r.number)):
            parts.setdefault(row.part, []).append(row.numbers)
        cells = Cells(np.array(parts["cell"]), metric)
        if "low" in parts:
            return cls(cells, ScalarCodes(np.array(parts["low"][0]), np.array(parts["high"][0])))
        books = sorted((p for p in parts if p.startswith("book ")), key=lambda p: int(p[5:]))
        return cls(cells, ProductCodes([np.array(parts[p]) for p in books]) if books else None)


def byte_rows(codes: np.ndarray) -> pa.Array:
    """Rows of a byte matrix as binary values."""
    codes = np.ascontiguousarray(codes)
    offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(offsets), pa.py_buffer(codes)])


def byte_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def residuals(collection: DataFrame, cells: Cells, vector: str) -> DataFrame:
    """Vectors without their cell's centroid, for training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, matrix = arrow_matrix(batch.column(vector), cells.centroids.shape[1])
            rest = matrix - cells.centroids[score_matrix("l2", matrix, cells.centroids).argmin(axis=1)]
            offsets = np.arange(0, rest.size + 1, rest.shape[1], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(rest.ravel()))
            yield pa.RecordBatch.from_arrays([column], names=["rest"])

    return collection.select(vector).mapInArrow(run, "rest array<double>")


def coded_rows(collection: DataFrame, coder: Coder, vector: str) -> DataFrame:
    """The collection with ``cell``, ``code`` and ``error``; rows without a vector are left out."""
    extra = [T.StructField("code", T.BinaryType()), T.StructField("error", T.FloatType()), T.StructField("cell", T.IntegerType())]
    schema = T.StructType([*collection.schema.fields, *extra])
    unit = coder.cells.metric == "cosine"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            kept, matrix = arrow_matrix(batch.column(vector), coder.centroids.shape[1])
            if unit:
                matrix, has_length = unit_rows(matrix)
                kept, matrix = kept[has_length], matrix[has_length]
            cell = score_matrix("l2", matrix, coder.centroids).argmin(axis=1).astype(np.int32)
            if coder.codes is None:
                code, error = pa.nulls(len(kept), pa.binary()), np.zeros(len(kept), np.float32)
            else:
                codes = coder.encode(matrix, cell)
                code = byte_rows(codes)
                off = np.sqrt(((matrix - coder.decode(codes, cell)) ** 2).sum(axis=1))
                error = np.nextafter(off.astype(np.float32), np.float32(np.inf))
            part = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*part.columns, code, pa.array(error), pa.array(cell)], schema=out)

    return collection.mapInArrow(run, schema)


def unit_vectors(collection: DataFrame, vector: str) -> DataFrame:
    """The vectors alone, of length one; those without a length are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, matrix = arrow_matrix(batch.column(vector))
            if not len(matrix):
                continue
            matrix, has_length = unit_rows(matrix)
            unit = matrix[has_length]
            offsets = np.arange(0, unit.size + 1, unit.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()))], names=[vector])

    return collection.select(vector).mapInArrow(run, T.StructType([T.StructField(vector, T.ArrayType(T.DoubleType()))]))


def unit_rows(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and which rows have a length."""
    norms = np.sqrt((matrix**2).sum(axis=1))
    return matrix / np.where(norms > 0, norms, 1)[:, None], norms > 0


# ---- indexes below a folder -------------------------------------------------


class StoredIndexes:
    """The indexes below ``root``, each under its own name."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str) -> SharedFolder:
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"bad index name {name!r}")
        return SharedFolder(self.spark, f"{self.root}/{name}")

    def names(self) -> list[str]:
        found = [n for n in SharedFolder(self.spark, self.root).names() if not n.startswith((".", "_"))]
        return [n for n in found if self.versions(n)]

    def has(self, name: str) -> bool:
        return bool(self.versions(name))

    def versions(self, name: str) -> list[int]:
        files = [n for n in self._folder(name).names() if n.startswith(MANIFEST)]
        return sorted(int(n[len(MANIFEST) : -len(".json")]) for n in files)

    def manifest(self, name: str, version: int | None = None) -> Manifest:
        versions = self.versions(name)
        if not versions or (version is not None and version not in versions):
            raise FileNotFoundError(f"no index {name} (version {version}) below {self.root}")
        number = versions[-1] if version is None else version
        return Manifest(**json.loads(self._folder(name).read(f"{MANIFEST}{number:08d}.json")))

    def open(self, name: str, version: int | None = None) -> StoredIndex:
        return StoredIndex(self.spark, f"{self.root}/{name}", self.manifest(name, version))

    def describe(self) -> DataFrame:
        """One row per index: what its current version is."""
        rows = []
        for name in self.names():
            m = self.manifest(name)
            rows.append((name, m.version, m.kind, m.metric, m.dim, m.cells, m.rows, m.nprobe, m.snapshot))
        schema = "name string, version long, kind string, metric string, dim long, cells long, n_rows long, nprobe long, snapshot string"
        return self.spark.createDataFrame(rows, schema)

    def drop(self, name: str) -> None:
        self._folder(name).remove()

    def expire(self, name: str, keep: int = 2) -> None:
        """Remove all but the last ``keep`` versions. Searches that still read an older one fail."""
        folder = self._folder(name)
        for number in self.versions(name)[: -max(1, keep)]:
            manifest = self.manifest(name, number)
            folder.remove(f"{MANIFEST}{number:08d}.json")
            folder.remove(manifest.folder)

    def build(
        self,
        collection: DataFrame,
        kind: str = "IVF_HNSW_SQ",
        metric: str = "l2",
        name: str | None = None,
        item_keys: Sequence[str] = ("id",),
        fields: Sequence[str] = (),
        vector: str = "vector",
        cells: int = PARTITIONS,
        sub_vectors: int = SUB_VECTORS,
        bits: int = CODE_BITS,
        iterations: int = ITERATIONS,
        sample_rate: int = SAMPLE_RATE,
        replace_existing: bool = True,
        snapshot: str | None = None,
        nprobe: int | None = None,
        seed: int = 7,
    ) -> StoredIndex:
        """Train, code and write a new version and publish it. ``fields`` are stored with the rows, as output fields.

        Models are fitted on bounded samples (see ``Cells``, ``ProductCodes``), every row with a vector is indexed (for
        cosine, with a length). Without ``nprobe`` the default number of probed cells is the least at which
        ``RECALL_ROWS`` sampled rows find ``WANTED_RECALL`` of their ``RECALL_AT`` nearest other rows; the measured recall of
        each number is in the manifest.
        """
        metric, coding = check_metric(metric), coding_of(kind)
        name = name or index_label(kind, metric)
        if not replace_existing and self.has(name):
            raise FileExistsError(f"index {name} exists")
        columns = list(dict.fromkeys([*item_keys, *fields, vector]))
        # training, coding and writing read the rows several times: a model that makes their vectors runs once
        copy = scratch_path(self.spark, "index-rows")
        collection.select(*columns).where(F.col(vector).isNotNull()).write.parquet(copy)
        rows = self.spark.read.parquet(copy)
        trained = rows if metric != "cosine" else unit_vectors(rows, vector)
        first = trained.select(F.size(vector).alias("dim")).first()
        if first is None:
            raise ValueError("an index needs a row with a vector")
        coarse = Cells.train(trained, metric, cells, iterations, vector, seed, sample_rate)
        codes: ScalarCodes | ProductCodes | None = None
        if coding == "sq":
            codes = ScalarCodes.train(residuals(trained, coarse, vector), "rest")
        elif coding == "pq":
            sample = training_rows(trained.select(vector), 2**bits * sample_rate, seed)
            codes = ProductCodes.train(residuals(sample, coarse, vector), sub_vectors, "rest", bits, seed=seed, sample_rate=sample_rate)
        coder = Coder(coarse, codes)
        folder = f"version-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}/{folder}"
        coded = coded_rows(rows, coder, vector)
        # the hint lets adaptive execution split a hot cell into several files
        coded.hint("rebalance", "cell").write.option("maxRecordsPerFile", 2_000_000).partitionBy("cell").parquet(f"{path}/rows")
        models = self.spark.createDataFrame(coder.table(), "part string, number int, numbers array<double>")
        models.coalesce(1).write.parquet(f"{path}/models")
        remove_folder(self.spark, copy)
        total = self.spark.read.parquet(f"{path}/rows").count()
        made = Manifest(
            name, kind, metric, first.dim, len(coarse.centroids), coding or "flat", list(item_keys), list(fields), vector, total, snapshot, folder
        )
        made = replace(made, nprobe=nprobe) if nprobe else self._measured(made, seed)
        return self._publish(made)

    def _measured(self, made: Manifest, seed: int) -> Manifest:
        index = StoredIndex(self.spark, f"{self.root}/{made.name}", made)
        keys = [f"_q{i}" for i in range(len(made.item_keys))]
        asked = training_rows(index.rows().select(*made.item_keys, made.vector), RECALL_ROWS, seed).limit(2 * RECALL_ROWS)
        asked = asked.select(*[F.col(c).alias(k) for c, k in zip(made.item_keys, keys)], F.col(made.vector).alias("vector"))
        local = self.spark.createDataFrame(asked.toArrow(), asked.schema)  # at most 2 * RECALL_ROWS vectors
        true = similarity_top_k(local, index.rows(), RECALL_AT + 1, made.metric, keys, made.item_keys, "vector", made.vector)
        # a row finds itself in its first cell, which says nothing about others
        true = true.where(~reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(made.item_keys, keys)]))
        # a true neighbour is found once the number of probed cells reaches its cell
        near = true.join(index.rows().select(*made.item_keys, "cell"), made.item_keys).select(*keys, "cell").collect()
        _, matrix = arrow_matrix(local.select("vector").toArrow().column("vector"))
        place = index.coder.cells.nearest(matrix, made.cells).argsort(axis=1)
        asked_rows = {tuple(r): i for i, r in enumerate(local.select(*keys).collect())}
        need = [int(place[asked_rows[tuple(r[k] for k in keys)], r.cell]) + 1 for r in near]
        counts, recall, probes = np.bincount(need, minlength=made.cells + 1), {}, 1
        while probes < made.cells:
            recall[str(probes)] = round(float(counts[: probes + 1].sum() / max(1, len(need))), 4)
            if recall[str(probes)] >= WANTED_RECALL:
                break
            probes += max(1, probes // 4)
        probes = min(probes, made.cells)
        recall.setdefault(str(probes), 1.0)
        return replace(made, nprobe=probes, recall=recall)

    def _publish(self, made: Manifest) -> StoredIndex:
        folder = self._folder(made.name)
        while True:  # another build may take the number first
            number = (self.versions(made.name) or [0])[-1] + 1
            numbered = replace(made, version=number)
            if folder.publish(f"{MANIFEST}{number:08d}.json", json.dumps(asdict(numbered), indent=1)):
                return StoredIndex(self.spark, f"{self.root}/{made.name}", numbered)


def open_index(spark: SparkSession, path: str, version: int | None = None) -> StoredIndex:
    """The index at a path that a build has returned (``StoredIndex.path``)."""
    root, _, name = path.rstrip("/").rpartition("/")
    return StoredIndexes(spark, root).open(name, version)


# ---- search -----------------------------------------------------------------


class StoredIndex:
    """One version of an index."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest):
        self.spark, self.path, self.manifest = spark, path.rstrip("/"), manifest
        models = spark.read.parquet(f"{self.path}/{manifest.folder}/models").collect()  # cells and codebooks, bounded
        self.coder = Coder.of_table(models, manifest.metric)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.manifest.folder}/rows")

    def search(
        self,
        queries: DataFrame,
        k: int,
        nprobe: int | None = None,
        query_keys: Sequence[str] = ("q_id",),
        vector: str = "vector",
        over_fetch: int | None = None,
        output_fields: Sequence[str] = (),
        strategy: str = "auto",
    ) -> DataFrame:
        """Best ``k`` rows per query in its ``nprobe`` best cells (default: the manifest's): query keys, item keys,
        ``score``, ``rank``, output fields. Exact for these cells unless ``over_fetch`` limits the candidates to
        ``over_fetch * k``. Scores are rounded to six places and ties go to the smallest keys, as in exact search.
        """
        m = self.manifest
        candidates, sent = self.candidates(queries, k, nprobe, query_keys, vector, over_fetch, strategy)
        items = self.rows()
        if sent.whole:
            items = items.where(F.col("cell").isin(self._asked(sent, nprobe or m.nprobe)))
        found = rescored(candidates, queries, items, k, m.metric, query_keys, m.item_keys, vector, m.vector, DIGITS)
        return with_fields(found, items, m.item_keys, output_fields, few_hits=sent.whole) if output_fields else found

    def _asked(self, sent, nprobe: int) -> list[int]:
        matrix = sent.block.value.matrix.reshape(-1, self.manifest.dim)
        return np.unique(self.coder.cells.nearest(matrix, min(nprobe, self.manifest.cells))).tolist()

    def candidates(self, queries, k, nprobe=None, query_keys=("q_id",), vector="vector", over_fetch=None, strategy="auto"):
        """Rows that may be among the ``k`` best (query keys, item keys, ``lower``, ``upper`` bounds of the cost), and
        the query set as it was sent."""
        m, coder = self.manifest, self.coder
        probes = min(nprobe or m.nprobe, m.cells)
        sent = sent_queries(queries, query_keys, vector, strategy)
        rows = self.rows().select(*m.item_keys, *(["code"] if coder.codes else [m.vector]), "error", "cell")
        if sent.whole:
            rows = rows.where(F.col("cell").isin(self._asked(sent, probes)))
        bounds = [T.StructField(c, T.DoubleType()) for c in ("lower", "upper")]
        schema = T.StructType([queries.schema[c] for c in query_keys] + [rows.schema[c] for c in m.item_keys] + bounds)
        keep = k if over_fetch is None else k * over_fetch
        item_keys, stored = m.item_keys, m.vector

        def passed(block, batches, out) -> Iterator[pa.RecordBatch]:
            search = BoundedSearch(coder, block.matrix, keep, probes, approximate=over_fetch is not None)
            for batch in batches:
                for asking, kept, lower, upper in search.batch(batch, stored):
                    columns = [block.keys.column(c).combine_chunks().take(pa.array(asking)) for c in block.keys.column_names]
                    columns += [pa.array(column_values(batch, c, kept)) for c in item_keys] + [pa.array(lower), pa.array(upper)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = to_arrow_schema(schema)
            for piece in [batches] if sent.whole else bounded_pieces(batches, ITEM_TILE_BYTES):
                for block in sent.blocks():
                    if len(block.matrix):
                        yield from passed(block, piece, out)

        shared_dir(self.spark)
        found = rows.mapInArrow(run, schema).checkpoint()  # read twice
        query_keys = list(query_keys)
        if over_fetch is not None:
            best = top_per_key(found, query_keys, [F.col("lower"), *[F.col(c) for c in item_keys]], keep)
            return best.drop("rank"), sent
        best = top_per_key(found.select(*query_keys, "upper"), query_keys, [F.col("upper")], k)
        reach = best.groupBy(*query_keys).agg(F.max("upper").alias("_reach"), F.count("*").alias("_n"))
        reach = reach.select(*query_keys, F.when(F.col("_n") >= k, F.col("_reach")).otherwise(float("inf")).alias("_reach"))
        reach = send_if_small(reach) if sent.whole else reach
        return found.join(reach, query_keys).where(F.col("lower") <= F.col("_reach")).drop("_reach"), sent


class BoundedSearch:
    """One task's way through coded rows: which of them may be among the ``k`` best of a query.

    Costs are squared distances or negative products, so smaller is better. The ``k`` smallest upper bounds per query
    are kept; a row whose lower bound is above all of them cannot be among the best of this task, let alone of all.
    """

    def __init__(self, coder: Coder, matrix: np.ndarray, k: int, probes: int, approximate: bool = False):
        self.coder, self.k, self.approximate = coder, k, approximate
        metric = coder.cells.metric
        self.has_length = np.ones(len(matrix), bool)
        if metric == "cosine":
            matrix, self.has_length = unit_rows(matrix)
        self.matrix, self.l2 = matrix, metric == "l2"
        self.norms = np.sqrt((matrix**2).sum(axis=1))
        self.probed = coder.cells.nearest(matrix, probes)
        self.best = np.full((len(matrix), k), np.inf)
        self.slack = 2 * 10.0**-DIGITS

    def costs(self, asking: np.ndarray, items: np.ndarray, cell: int) -> np.ndarray:
        queries = self.matrix[asking]
        if self.coder.codes is not None:
            return self.coder.costs(queries, items, cell)
        return score_matrix("l2", queries, items) if self.l2 else -score_matrix("ip", queries, items)

    def bounds(self, asking: np.ndarray, costs: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.approximate:
            return costs, costs
        if self.l2:
            # a squared distance from products is off by about the rounding of its largest part
            noise = 1e-12 * (self.norms[asking][:, None] ** 2 + np.abs(costs) + 1)
            away = np.sqrt(np.maximum(costs, 0) + noise)
            near = np.sqrt(np.maximum(costs - noise, 0))
            return np.maximum(near - error, 0) ** 2 - self.slack, (away + error) ** 2 + self.slack
        off = self.norms[asking][:, None] * error + self.slack
        return costs - off, costs + off

    def batch(self, batch: pa.RecordBatch, vector: str) -> Iterator[tuple]:
        """(queries, rows of the batch, lower bounds, upper bounds) that are still in the race, cell by cell."""
        cell = batch.column("cell").to_numpy(zero_copy_only=False)
        error = batch.column("error").to_numpy(zero_copy_only=False).astype(np.float64)
        if self.coder.codes is not None:
            items = byte_matrix(batch.column("code"))
        else:
            _, items = arrow_matrix(batch.column(vector), self.matrix.shape[1])
            if self.coder.cells.metric == "cosine":
                items, _ = unit_rows(items)
        for number in np.unique(cell).tolist():
            members = np.flatnonzero(cell == number)
            asked = np.flatnonzero((self.probed == number).any(axis=1) & self.has_length)
            step = max(1, MAX_CELLS // (4 * len(members)))
            for low in range(0, len(asked), step):
                asking = asked[low : low + step]
                lower, upper = self.bounds(asking, self.costs(asking, items[members], number), error[members])
                both = np.concatenate([self.best[asking], upper], axis=1)
                self.best[asking] = np.partition(both, self.k - 1, axis=1)[:, : self.k]
                row, col = np.nonzero(lower <= self.best[asking].max(axis=1)[:, None])
                if len(row):
                    yield asking[row], members[col], lower[row, col], upper[row, col]
