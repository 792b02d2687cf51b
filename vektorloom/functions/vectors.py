"""Vector maths as column expressions, and the numpy side used inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: metric name -> does a larger score rank first
LARGER_FIRST = {"l2": False, "ip": True, "cosine": True}


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a, b) -> Column:
    """Inner product, summed in double."""
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(v) -> Column:
    return F.sqrt(dot(v, v))


def squared_l2(a, b) -> Column:
    """Squared Euclidean distance, the value vector stores report for L2."""
    gaps = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, d: total + d * d)


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector has no length."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def score(metric: str, a, b) -> Column:
    return {"l2": squared_l2, "ip": dot, "cosine": cosine}[check_metric(metric)](a, b)


def normalise(v) -> Column:
    """Row scaled to unit length; NULL for the zero vector."""
    column = _column(v)
    norm = l2_norm(column)
    return F.when(norm > 0, F.transform(column, lambda x: x.cast("double") / norm))


def row_max(v) -> Column:
    return F.array_max(_column(v))


def is_valid(v, dim: int) -> Column:
    """Right length and no NULL, NaN or infinite component."""
    column = _column(v)
    bad = F.exists(
        column,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return F.coalesce((F.size(column) == dim) & ~bad, F.lit(False))


def check_metric(metric: str) -> str:
    name = metric.lower()
    if name not in LARGER_FIRST:
        raise ValueError(f"unknown metric {metric!r}; use one of {sorted(LARGER_FIRST)}")
    return name


# ---- numpy side -------------------------------------------------------------


def arrow_matrix(column: pa.Array | pa.ChunkedArray, dim: int | None = None):
    """(rows kept, matrix) of a list column. NULL vectors are left out; ragged ones raise."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kept = np.flatnonzero(np.asarray(column.is_valid()))
    if len(kept) < len(column):
        column = column.take(pa.array(kept))
    if len(column) == 0:
        return kept, np.empty((0, dim or 0))
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    width = int(lengths[0]) if dim is None else dim
    if (lengths != width).any():
        raise ValueError(f"vectors of length {sorted(set(lengths.tolist()))}, expected {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return kept, flat.astype(np.float64).reshape(len(column), width)


def score_matrix(metric: str, queries: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Scores of every query row against every item row."""
    products = queries @ items.T
    if metric == "ip":
        return products
    query_sq = np.einsum("ij,ij->i", queries, queries)[:, None]
    item_sq = np.einsum("ij,ij->i", items, items)[None, :]
    if metric == "l2":
        return np.maximum(query_sq + item_sq - 2.0 * products, 0.0)
    lengths = np.sqrt(query_sq) * np.sqrt(item_sq)
    return np.divide(products, lengths, out=np.full_like(products, np.nan), where=lengths > 0)
