"""Embedding texts with a user model, and vector preparation.

A model is given as a factory: a function without arguments that is called once per Python worker
and returns ``texts -> matrix``. Work is spread by partitions, so several devices simply mean
several executors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektorloom.functions.text import WORD_PATTERN
from vektorloom.functions.vectors import arrow_matrix, is_valid, l2_norm, normalise
from vektorloom.operators.spread import spread_small

EncoderFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]


def word_count_encoder(dim: int = 64, normalised: bool = False) -> EncoderFactory:
    """Model-free default: counts of words per hash bucket (first 32 bits of MD5, modulo ``dim``)."""

    def load():
        find_words = re.compile(WORD_PATTERN).findall

        class Buckets(dict):
            def __missing__(self, word: str) -> int:
                self[word] = number = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % dim
                return number

        buckets = Buckets()

        def encode(texts: Sequence[str]) -> np.ndarray:
            if len(buckets) > 500_000:
                buckets.clear()
            rows = np.zeros((len(texts), dim), dtype=np.float32)
            for row, text in enumerate(texts):
                hits = [buckets[w] for w in find_words((text or "").lower())]
                if hits:
                    rows[row] = np.bincount(hits, minlength=dim)
            if normalised:
                norms = np.linalg.norm(rows, axis=1, keepdims=True)
                np.divide(rows, norms, out=rows, where=norms > 0)
            return rows

        return encode

    return load


def embed(
    df: DataFrame,
    text: str = "text",
    encoder: EncoderFactory | None = None,
    name: str = "vector",
    batch_size: int = 1024,
) -> DataFrame:
    """Add the model's vector of a text column as ``array<float>``."""
    factory = encoder or word_count_encoder()

    def make_predict():
        encode = factory()

        def predict(texts: np.ndarray) -> np.ndarray:
            return np.asarray(encode(list(texts)), dtype=np.float32)

        return predict

    model = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    # keeps the optimizer from copying the model call into a filter and running it twice
    model = model.asNondeterministic()
    return spread_small(df).withColumn(name, model(F.col(text)))


def embed_multi(
    df: DataFrame,
    key: str,
    text: str,
    encoder: Callable[[], Callable[[Sequence[str]], list[np.ndarray]]],
    seq: str = "seq_id",
    batch_size: int = 64,
) -> DataFrame:
    """One row per (key, position) from a model that returns several vectors for each text or page."""
    out = T.StructType(
        [df.schema[key], T.StructField(seq, T.LongType()), T.StructField("vector", T.ArrayType(T.FloatType()))]
    )

    def run(batches):
        encode = encoder()
        for batch in batches:
            for low in range(0, batch.num_rows, batch_size):
                part = batch.slice(low, batch_size)
                for name, matrix in zip(part.column(key).to_pylist(), encode(part.column(text).to_pylist())):
                    rows = np.asarray(matrix, dtype=np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(rows)),
                            pa.array(np.arange(len(rows), dtype=np.int64)),
                            pa.array(list(rows), type=pa.list_(pa.float32())),
                        ],
                        names=[key, seq, "vector"],
                    )

    return spread_small(df.select(key, text)).mapInArrow(run, out)


def explode_vectors(df: DataFrame, key: str, vectors: str, seq: str = "seq_id") -> DataFrame:
    """``array<array<float>>`` per document -> one row per (document, position)."""
    kept = [c for c in df.columns if c != vectors]
    return df.select(*kept, F.posexplode(vectors).alias(seq, "vector")).withColumn(seq, F.col(seq).cast("long"))


def normalised(df: DataFrame, vector: str = "vector") -> DataFrame:
    """Unit-length vectors; the zero vector becomes NULL instead of a division by zero."""
    return df.withColumn(vector, normalise(vector).cast("array<float>"))


def dimension(df: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: smallest and largest vector length and the row count."""
    return df.agg(
        F.min(F.size(vector)).cast("long").alias("min_dim"),
        F.max(F.size(vector)).cast("long").alias("max_dim"),
        F.count("*").alias("n_rows"),
    )


def split_valid(df: DataFrame, dim: int, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) by length and finite components."""
    checked = is_valid(vector, dim)
    return df.where(checked), df.where(~checked)


def require_valid(df: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """Fail the job on the first bad vector."""
    problem = F.raise_error(F.lit(f"bad vector: expected {dim} finite components"))
    return df.withColumn(vector, F.when(is_valid(vector, dim), F.col(vector)).otherwise(problem))


def norms(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(key, l2_norm(vector).alias("norm"))


def mean_vectors(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Mean vector per key, e.g. class prototypes. Each task sums its rows before the shuffle."""
    keys = list(keys)
    partial = T.StructType(
        [df.schema[c] for c in keys]
        + [T.StructField("_sum", T.ArrayType(T.DoubleType())), T.StructField("_n", T.LongType())]
    )

    def sums(batches):
        for batch in batches:
            kept, matrix = arrow_matrix(batch.column(vector))
            if not len(kept):
                continue
            groups = batch.select(keys).to_pandas().iloc[kept].reset_index(drop=True).groupby(keys, dropna=False)
            names = list(groups.indices.items())
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        **dict(zip(keys, name if isinstance(name, tuple) else (name,))),
                        "_sum": matrix[rows].sum(axis=0),
                        "_n": len(rows),
                    }
                    for name, rows in names
                ],
                schema=_arrow(partial),
            )

    per_task = df.select(*keys, vector).mapInArrow(sums, partial)
    by_dim = per_task.select(*keys, "_n", F.posexplode("_sum").alias("_dim", "_x")).groupBy(*keys, "_dim")
    means = by_dim.agg((F.sum("_x") / F.sum("_n")).alias("_x"))
    return means.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("_dim", "_x"))).alias("_cells")
    ).select(*keys, F.col("_cells._x").alias(vector))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
