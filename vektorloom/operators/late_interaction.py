"""Multi-vector search: candidate documents, then the sum of best matches per query token."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.functions.vectors import arrow_matrix, score_matrix
from vektorloom.operators.index import Cells
from vektorloom.operators.ranking import top_per_key
from vektorloom.operators.search import MAX_CELLS, QueryBlock, bounded_queries, cut_into_tiles, similarity_top_k
from vektorloom.operators.spread import send_if_small, table_if_small
from vektorloom.session import shared_dir


def candidate_documents(tokens: DataFrame, rows: DataFrame, per_token: int = 50, metric: str = "ip") -> DataFrame:
    """Distinct (q_id, doc_id) over the best ``per_token`` collection rows of every query token."""
    hits = similarity_top_k(
        tokens, rows, per_token, metric, query_keys=("q_id", "q_seq"), item_keys=("doc_id", "seq_id")
    )
    return hits.select("q_id", "doc_id").distinct()


def max_sim(
    tokens: DataFrame,
    rows: DataFrame,
    candidates: DataFrame,
    top_k: int,
    digits: int = 6,
    strategy: str = "auto",
) -> DataFrame:
    """Documents per query by the sum over query tokens of the best inner product with any row.

    ``tokens(q_id, q_seq, vector)``, ``rows(doc_id, seq_id, vector)``, ``candidates(q_id, doc_id)``.
    Every task reduces its rows of a document to one best value per token before the shuffle, so a
    document with very many rows is never gathered.
    """
    schema = best_schema(tokens, rows, ["best"])
    items = rows.select("doc_id", "vector")
    best = None if strategy == "tiles" else asked_best(tokens, items, candidates, schema, _products)
    if best is None:
        best = _tile_best(tokens, rows, candidates, schema)
    per_token = best.groupBy("q_id", "doc_id", "q_seq").agg(F.max("best").alias("best"))
    scores = per_token.groupBy("q_id", "doc_id").agg(F.round(F.sum("best"), digits).alias("score"))
    return top_per_key(scores, ["q_id"], [F.col("score").desc(), F.col("doc_id")], top_k)


def best_schema(tokens: DataFrame, rows: DataFrame, values: list[str]) -> T.StructType:
    names = [tokens.schema["q_id"], rows.schema["doc_id"], tokens.schema["q_seq"]]
    return T.StructType(names + [T.StructField(v, T.DoubleType()) for v in values])


def _products(matrix: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    kept, items = arrow_matrix(batch.column("vector"), matrix.shape[1])
    return kept, [matrix @ items.T]


@dataclass
class Asked:
    """Query tokens in the order of their queries, and which queries ask for which document (sorted by document)."""

    q_ids: np.ndarray
    q_seqs: np.ndarray
    matrix: np.ndarray
    first: np.ndarray
    count: np.ndarray
    docs: np.ndarray
    query: np.ndarray

    @classmethod
    def of(cls, block: QueryBlock, pairs: pa.Table) -> Asked:
        q_ids = np.array(block.keys.column("q_id").to_pylist())
        order = np.argsort(q_ids, kind="stable")
        names, first, count = np.unique(q_ids[order], return_index=True, return_counts=True)
        wanted = np.array(pairs.column("q_id").to_pylist())
        known = np.isin(wanted, names)
        docs = np.array(pairs.column("doc_id").to_pylist())[known]
        by_doc = np.argsort(docs, kind="stable")
        query = np.searchsorted(names, wanted[known])[by_doc]
        q_seqs = np.array(block.keys.column("q_seq").to_pylist())[order]
        return cls(q_ids[order], q_seqs, block.matrix[order], first, count, docs[by_doc], query)

    def tokens_for(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``docs``, token) of everything that is asked of these documents."""
        low = np.searchsorted(self.docs, docs, "left")
        place, pair = spans(low, np.searchsorted(self.docs, docs, "right") - low)
        query = self.query[pair]
        owner, token = spans(self.first[query], self.count[query])
        return place[owner], token


def spans(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ``first[i] .. first[i] + count[i] - 1`` one after another, each with its ``i``."""
    owner = np.repeat(np.arange(len(first)), count)
    start = np.cumsum(count) - count
    return owner, np.arange(len(owner)) - start[owner] + first[owner]


def asked_best(
    tokens: DataFrame,
    rows: DataFrame,
    candidates: DataFrame,
    schema: T.StructType,
    score: Callable[[np.ndarray, pa.RecordBatch], tuple[np.ndarray, list[np.ndarray]]],
) -> DataFrame | None:
    """The largest scores per (query, document, token) in each batch of rows, for the documents that are asked for.

    ``score(token matrix, batch)`` gives the rows that count and one or more (tokens x rows) matrices. Tokens and the
    list of candidates are sent to the tasks once; None if they are too large for that. The documents are picked by a
    join on their ids alone.
    """
    block = bounded_queries(tokens, ["q_id", "q_seq"], "vector")
    pairs = None if block is None else table_if_small(candidates.select("q_id", "doc_id"))
    if pairs is None:
        return None
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Asked.of(block, pairs))
    wanted = spark.createDataFrame(pairs.select(["doc_id"]), T.StructType([candidates.schema["doc_id"]])).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, asked = to_arrow_schema(schema), shared.value
        for batch in batches if len(asked.matrix) else ():
            names = np.array(batch.column("doc_id").to_pylist())
            # rows of a document one after another
            order = np.argsort(names, kind="stable")
            batch = batch.take(pa.array(order))
            kept, _ = score(asked.matrix[:0], batch)
            if not len(kept):
                continue
            names = names[order][kept]
            starts = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            place, token = asked.tokens_for(names[starts])
            needed, number = np.unique(token, return_inverse=True)
            step = max(1, MAX_CELLS // len(names))
            for low in range(0, len(needed), step):
                _, scores = score(asked.matrix[needed[low : low + step]], batch)
                here = np.flatnonzero((number >= low) & (number < low + step))
                best = [np.maximum.reduceat(s, starts, axis=1)[number[here] - low, place[here]] for s in scores]
                columns = [asked.q_ids[token[here]], names[starts][place[here]], asked.q_seqs[token[here]], *best]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, out)], schema=out)

    return rows.join(F.broadcast(wanted), "doc_id", "left_semi").mapInArrow(run, schema)


def _tile_best(tokens: DataFrame, rows: DataFrame, candidates: DataFrame, schema: T.StructType) -> DataFrame:
    """Any number of query tokens: tiles of a document's rows meet tiles of the tokens that ask for it."""
    asking = candidates.join(tokens.select("q_id", "q_seq", "vector"), "q_id")
    items = rows.select("doc_id", "seq_id", "vector")
    widest = tokens.select(F.size("vector").alias("dim")).first()
    left, right = cut_into_tiles(
        asking, items, "doc_id", ["q_id", "q_seq"], ["seq_id"], widest.dim if widest else 1
    )
    def meet(asked: pa.Table, found: pa.Table) -> pa.Table:
        out = to_arrow_schema(schema)
        if not asked.num_rows or not found.num_rows:
            return out.empty_table()
        kept, queries = arrow_matrix(asked.column("vector"))
        top = np.full(len(kept), -np.inf)
        for batch in found.combine_chunks().to_batches(max_chunksize=4096):
            _, items = arrow_matrix(batch.column("vector"))
            if len(items):
                np.maximum(top, (queries @ items.T).max(axis=1), out=top)
        names = asked.select(["q_id", "doc_id", "q_seq"]).take(pa.array(kept))
        result = pa.table([*names.columns, pa.array(top)], names=out.names).cast(out)
        return result.filter(pa.array(np.isfinite(top)))

    on = ["doc_id", "_q", "_c"]
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, schema)


# ---- documents that cannot be among the best ---------------------------------


def document_cells(rows: DataFrame, cells: Cells) -> DataFrame:
    """``doc_id, cell, near, far``: the cells that a document's rows lie in, with the least and largest distance of its
    rows to the centroid. A table of few numbers per document, made once and kept with the collection."""
    schema = T.StructType([rows.schema["doc_id"], T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            kept, items = arrow_matrix(batch.column("vector"), cells.centroids.shape[1])
            cell = score_matrix("l2", items, cells.centroids).argmin(axis=1).astype(np.int32)
            away = np.sqrt(((items - cells.centroids[cell]) ** 2).sum(axis=1))
            docs = batch.column("doc_id").take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([docs, pa.array(cell), pa.array(away)], schema=out)

    placed = rows.select("doc_id", "vector").mapInArrow(run, schema)
    return placed.groupBy("doc_id", "cell").agg(F.min("away").alias("near"), F.max("away").alias("far"))


def reaching_documents(
    tokens: DataFrame, summary: DataFrame, cells: Cells, candidates: DataFrame, top_k: int, digits: int = 6
) -> DataFrame:
    """The candidates (q_id, doc_id) that can be among the ``top_k`` by late interaction, from cells alone.

    A token's product with a row differs from its product with the row's centroid by at most its length times the row's
    distance to the centroid. So the cells of a document bound its score from both sides, and a document whose upper
    bound is below the ``top_k``-th lower bound of its query cannot be in the answer. None is lost.
    """
    centroids = cells.centroids

    def bounds(matrix: np.ndarray, batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        cell, near, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "near", "far"))
        middle = matrix @ centroids[cell].T
        length = np.sqrt((matrix**2).sum(axis=1))[:, None]
        return np.arange(len(cell)), [middle + length * far, middle - length * near]

    best = asked_best(tokens, summary, candidates, best_schema(tokens, summary, ["upper", "lower"]), bounds)
    if best is None:
        return candidates.select("q_id", "doc_id")
    per_token = best.groupBy("q_id", "doc_id", "q_seq").agg(F.max("upper").alias("upper"), F.max("lower").alias("lower"))
    shared_dir(tokens.sparkSession)
    per_doc = per_token.groupBy("q_id", "doc_id").agg(F.sum("upper").alias("upper"), F.sum("lower").alias("lower")).checkpoint()
    leading = top_per_key(per_doc, ["q_id"], [F.col("lower").desc()], top_k)
    reach = leading.groupBy("q_id").agg(F.min("lower").alias("_reach"), F.count("*").alias("_n")).where(F.col("_n") >= top_k)
    slack = 2 * 10.0**-digits  # scores may tie after rounding
    kept = per_doc.join(send_if_small(reach.drop("_n")), "q_id", "left")
    enough = F.col("_reach").isNull() | (F.col("upper") + slack + F.abs("upper") * 1e-9 >= F.col("_reach"))
    return kept.where(enough).select("q_id", "doc_id")


def fetch_documents(rows: DataFrame, candidates: DataFrame, limit: int | None = None) -> DataFrame:
    """Collection rows of the candidate documents, optionally at most ``limit`` per document."""
    kept = rows.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    if limit is None:
        return kept
    return top_per_key(kept, ["doc_id"], [F.col("seq_id")], limit, rank="_n").drop("_n")
