"""Indexes built in one place and used from another: cells with codes, certified bounds, retrieval through an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.operators.stored_index import StoredIndexes, open_index
from vektorloom.plans.answering import answer
from vektorloom.session import scratch_path
from workload.registry import ORACLES, query
from workload.search import knn_sql, prototypes, questions_of, text_collection, vectors


def built(spark, sf, kind: str, metric: str, cells: int, **options):
    indexes = StoredIndexes(spark, scratch_path(spark, "indexes"))
    return indexes.build(vectors(spark, sf), kind, metric, cells=cells, iterations=10, **options)


@query(knn_sql("l2"))
def index_reopened(spark, sf):
    """Built, forgotten, and opened again from its path alone; every cell is probed."""
    path = built(spark, sf, "IVF_HNSW_SQ", "l2", 16).path
    return open_index(spark, path).search(prototypes(spark, sf), 10, nprobe=16)


@query(knn_sql("ip"))
def ivf_sq_search(spark, sf):
    return built(spark, sf, "IVF_HNSW_SQ", "ip", 16, nprobe=16).search(prototypes(spark, sf), 10)


@query(knn_sql("l2"))
def ivf_pq_search(spark, sf):
    return built(spark, sf, "IVF_PQ", "l2", 16, sub_vectors=16, bits=6, nprobe=16).search(prototypes(spark, sf), 10)


@query(knn_sql("l2", 25))
def sq_certified(spark, sf):
    """Every cell is probed: the bounds leave no true neighbour out, whatever ``k``."""
    return built(spark, sf, "IVF_HNSW_SQ", "l2", 2, nprobe=2).search(prototypes(spark, sf), 25)


@query(knn_sql("cosine", 25))
def pq_certified(spark, sf):
    return built(spark, sf, "IVF_PQ", "cosine", 2, sub_vectors=16, bits=6, nprobe=2).search(prototypes(spark, sf), 25)


@query()
def index_default(spark, sf):
    """The number of probed cells that the build has measured; not all cells, so no twin (recall is tested)."""
    return built(spark, sf, "IVF_HNSW_SQ", "l2", 16).search(prototypes(spark, sf), 10)


@query("SELECT 'embeddings' AS name, 2 AS version, 'IVF_FLAT' AS kind, 'cosine' AS metric, 64 AS dim, 4 AS cells, count(*) AS n_rows FROM embeddings")
def index_catalog(spark, sf):
    """The indexes of a folder after a first and a second build of one and the drop of another."""
    indexes = StoredIndexes(spark, scratch_path(spark, "indexes"))
    for kind, name in (("IVF_HNSW_SQ", "embeddings"), ("IVF_FLAT", "other"), ("IVF_FLAT", "embeddings")):
        indexes.build(vectors(spark, sf), kind, "cosine", name, cells=4, iterations=2, nprobe=1)
    indexes.drop("other")
    return indexes.describe().select("name", "version", "kind", "metric", "dim", "cells", "n_rows")


@query(ORACLES["answer_questions"])
def answer_indexed(spark, sf):
    """The questions answered through an index over the embedded chunks, with their texts as stored fields."""
    indexes = StoredIndexes(spark, scratch_path(spark, "indexes"))
    chunks = text_collection(spark, sf)
    index = indexes.build(chunks, "IVF_HNSW_SQ", "cosine", "chunks", ("doc_id", "seq_id"), ("text",), cells=16, iterations=5, nprobe=16)
    answered = answer(questions_of(spark, sf), k=10, top_n=5, index=index)
    return answered.select(
        "q_id",
        "user_input",
        "response",
        F.size("retrieved_contexts").cast("long").alias("n_contexts"),
        F.md5("prompt").alias("prompt_md5"),
    )
