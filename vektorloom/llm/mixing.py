"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorloom.llm.common import settled
from vektorloom.operators.spread import send_if_small
from vektorloom.session import remove_folder, scratch_path

#: Cells that are fitted on the driver; more are fitted as tables, with the same result.
MOST_CELLS = 200_000
MISSING = "(none)"

#: Rounds of fitting, and how far the sums may be from the targets at the end.
ROUNDS, TOLERANCE = 200, 1e-9

#: Factors that are tried at once in a pass over a table of cells.
TRIED = 64


def topic_of(text: Column) -> Column:
    """A coarse topic from the make-up of a text: ``empty, short, loud, signs, digits`` or ``prose``."""
    n = F.char_length(text)
    share = lambda pattern: (n - F.char_length(F.regexp_replace(text, pattern, ""))) / n
    return (
        F.when(n == 0, "empty")
        .when(n < 200, "short")
        .when(share("[A-Z]+") > 0.3, "loud")
        .when(share(r"[^\p{L}\p{N}\s]+") > 0.15, "signs")
        .when(share(r"\p{N}+") > 0.1, "digits")
        .otherwise("prose")
    )


def words_of(text: Column) -> Column:
    """Words between white space: the token weight of a text."""
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "))) + 1).cast("long")


def weighed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, lang, topic, tokens`` of every document; null categories are named, null texts empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit(MISSING)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(MISSING)).alias("lang"),
        topic_of(text).alias("topic"),
        words_of(text).alias("tokens"),
        *carry,
    )


def rake(weights: np.ndarray, targets: Sequence[np.ndarray], at: Sequence[np.ndarray] | None = None) -> np.ndarray:
    """Iterative proportional fitting: ``weights`` scaled along each axis in turn until its sums are the targets.

    ``at`` gives the category of each weight per axis for a list of cells; without it ``weights`` has an axis per
    dimension. Categories without weight keep none; the targets of an axis are taken relative to those that have some.
    """
    fitted = (weights / weights.sum()).ravel()
    places = [i.ravel() for i in np.indices(weights.shape)] if at is None else at
    wanted = []
    for own, target in zip(places, targets):
        present = np.where(np.bincount(own, fitted, len(target)) > 0, target, 0.0)
        wanted.append((own, present / present.sum()))
    for _ in range(ROUNDS):
        worst = 0.0
        for own, target in wanted:
            sums = np.bincount(own, fitted, len(target))
            factor = np.divide(target, sums, out=np.zeros_like(target), where=sums > 0)
            worst = max(worst, float(np.abs(sums - target).max()))
            fitted = fitted * factor[own]
        if worst < TOLERANCE:
            break
    return fitted.reshape(weights.shape)


def fitted_cells(
    rows: DataFrame, powers: Mapping[str, float], keep: float, targets: Mapping[str, Mapping[str, float]] | None = None
) -> DataFrame | None:
    """Raked weights per cell of the named dimensions, from ``weighed`` rows: ``<dim> ..., weight, probability`` (None
    without any tokens).

    ``powers`` names the dimensions and how far their marginals are tempered, between the present shares (1) and equal
    ones (0); ``targets`` gives shares instead, and a category that these leave out has a share of 0. ``keep`` is the
    share of tokens that sampling keeps in expectation: probabilities are the weights times one factor, cut at 1. Every
    category has a marginal of its own. At most ``MOST_CELLS`` sums come to the driver; more are fitted where they are.
    """
    cells = rows.groupBy(*powers).agg(F.sum("tokens").alias("n")).where("n > 0")
    near = cells.limit(MOST_CELLS + 1).toArrow()
    if not near.num_rows:
        return None
    if near.num_rows <= MOST_CELLS:
        return fitted_here(rows.sparkSession, near, powers, keep, targets or {})
    return fitted_as_tables(settled(cells, "cells"), powers, keep, targets or {})


def fitted_here(spark: SparkSession, cells: pa.Table, powers: Mapping[str, float], keep: float, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    cells = cells.sort_by([(d, "ascending") for d in powers])
    weights = cells.column("n").to_numpy().astype(float)
    at, wanted = [], []
    for d, power in powers.items():
        coded = cells.column(d).combine_chunks().dictionary_encode()
        own = coded.indices.to_numpy()
        shares = np.bincount(own, weights) ** power
        if d in targets:
            shares = np.array([targets[d].get(k, 0.0) for k in coded.dictionary.to_pylist()])
        at.append(own)
        wanted.append(shares)
    factors = rake(weights, wanted, at) * weights.sum() / weights
    probabilities = np.minimum(1.0, keeping_factor(weights, factors, keep) * factors)
    made = cells.select(list(powers)).append_column("weight", pa.array(factors)).append_column("probability", pa.array(probabilities))
    return spark.createDataFrame(made)


def fitted_as_tables(cells: DataFrame, powers: Mapping[str, float], keep: float, targets: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``fitted_here`` by aggregations: sums per category, factors joined to the cells, a written table per round."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("n")).first()[0])
    wanted = {}
    for d, power in powers.items():
        shares = cells.groupBy(d).agg(F.pow(F.sum("n").cast("double") / total, F.lit(float(power))).alias("share"))
        if d in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, given double")
            shares = shares.join(given, d, "left").select(d, F.coalesce("given", F.lit(0.0)).alias("share"))
        shares = settled(shares, f"shares-{d}")
        wanted[d] = shares.select(d, (F.col("share") / F.lit(float(shares.agg(F.sum("share")).first()[0]))).alias("target"))
    fitted, folder = cells.withColumn("fitted", F.col("n") / F.lit(total)), None
    for _ in range(ROUNDS):
        worst = 0.0
        written = []
        for d in powers:
            sums = fitted.groupBy(d).agg(F.sum("fitted").alias("sum")).join(wanted[d], d)
            factor = F.when(F.col("sum") > 0, F.col("target") / F.col("sum")).otherwise(0.0).alias("factor")
            factors, path = rewritten(sums.select(d, factor, F.abs(F.col("sum") - F.col("target")).alias("off")), "factors")
            worst = max(worst, float(factors.agg(F.max("off")).first()[0]))
            scaled = fitted.join(send_if_small(factors.drop("off")), d)
            fitted = scaled.select(*powers, "n", (F.col("fitted") * F.col("factor")).alias("fitted"))
            written.append(path)
        fitted, path = rewritten(fitted, "fitted")
        for old in (folder, *written):
            if old:
                remove_folder(spark, old)
        folder = path
        if worst < TOLERANCE:
            break
    made = fitted.select(*powers, "n", (F.col("fitted") * F.lit(total) / F.col("n")).alias("weight"))
    low, high = 0.0, 1.0 / max(made.where("weight > 0").agg(F.min("weight")).first()[0], 1e-12)
    while high - low > 1e-14 * high:
        tried = [low + (high - low) * (k + 1) / TRIED for k in range(TRIED - 1)]
        kept = made.agg(*(F.sum(F.col("n") * F.least(F.lit(1.0), F.col("weight") * F.lit(c))).alias(f"k{k}") for k, c in enumerate(tried))).first()
        short = [c for c, k in zip(tried, kept) if k / total < keep]
        enough = [c for c, k in zip(tried, kept) if k / total >= keep]
        before = low, high
        low, high = max([low, *short]), min([high, *enough])
        if (low, high) == before:
            break
    return made.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * F.lit(high))).drop("n")


def rewritten(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``settled``, with the folder, for tables of one round that the next does not need."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def with_cells(rows: DataFrame, dims: Iterable[str], cells: DataFrame | None) -> DataFrame:
    """``rows`` with the ``weight`` and ``probability`` of their cell; texts without tokens weigh nothing and always stay."""
    if cells is None:
        return rows.withColumns({"weight": F.lit(1.0), "probability": F.lit(1.0)})
    met = rows.join(send_if_small(cells), list(dims), "left")
    one = lambda c: F.coalesce(F.when(F.col("tokens") > 0, F.col(c)), F.lit(1.0)).alias(c)
    return met.select(*rows.columns, one("weight"), one("probability"))


def keeping_factor(weights: np.ndarray, factors: np.ndarray, keep: float) -> float:
    """The factor for which probabilities ``min(1, factor * weight)`` keep the share ``keep`` of all tokens."""
    low, high = 0.0, 1.0 / max(factors[factors > 0].min(), 1e-12)
    for _ in range(200):
        middle = (low + high) / 2
        kept = (weights * np.minimum(1.0, middle * factors)).sum() / weights.sum()
        low, high = (middle, high) if kept < keep else (low, middle)
    return high


#: How the registered query and the pipeline mix: sources and languages are drawn halfway to equal shares of the tokens
#: on a logarithmic scale, topics stay as they are; nine tenths of the tokens are kept.
POWERS = {"source": 0.5, "lang": 0.5, "topic": 1.0}
KEEP = 0.9


def sampled(docs: DataFrame, powers: Mapping[str, float] = POWERS, keep: float = KEEP, seed: int = 17) -> DataFrame:
    """One row per document: ``doc_id, source, lang, topic, tokens, weight, probability, draw, sampled``.

    A document is drawn if a number in [0, 1) made from its id and the seed is below its probability, so the same
    rows are drawn on every run. Null sources and languages are a category, a null id is a value of its own, null and
    empty texts are always drawn, repeated rows are drawn together, an empty table gives no rows, and other columns
    are not read.
    """
    rows = settled(weighed(docs), "weighed")
    met = with_cells(rows, powers, fitted_cells(rows, powers, keep)).withColumn("draw", draw(F.col("doc_id"), seed))
    return met.withColumn("sampled", F.col("draw") < F.col("probability"))


def draw(doc_id: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 11)
    return bits / F.lit(float(1 << 53))


def mixed(docs: DataFrame, powers: Mapping[str, float] = POWERS, keep: float = KEEP, seed: int = 17) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``sampled`` draws. Texts do not move, unless there are too many
    cells to send them to every task."""
    narrow = settled(weighed(docs), "weighed")
    whole = docs.select("doc_id", "source", "lang", "text", F.struct(*docs.columns).alias("_row"))
    met = with_cells(weighed(whole, ["_row"]), powers, fitted_cells(narrow, powers, keep))
    return met.where(draw(F.col("doc_id"), seed) < F.col("probability")).select("_row.*")
