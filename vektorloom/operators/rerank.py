"""Second-stage ranking of retrieved candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektorloom.functions.text import words
from vektorloom.operators.ranking import top_per_key
from vektorloom.operators.spread import over_all_cores

#: called once per Python worker, returns (queries, documents) -> scores
ScorerFactory = Callable[[], Callable[[Sequence[str], Sequence[str]], Sequence[float]]]


def word_overlap(query: Column, document: Column) -> Column:
    """Default scorer: distinct lower-case words the two texts share."""
    return F.size(F.array_intersect(words(query), words(document))).cast("double")


def model_score(factory: ScorerFactory, query: Column, document: Column) -> Column:
    """Scores from a user model over Arrow batches of pairs."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = factory()
        for queries, documents in pairs:
            scores = list(score(queries.tolist(), documents.tolist()))
            if len(scores) != len(queries):
                raise ValueError(f"{len(scores)} scores for {len(queries)} pairs")
            yield pd.Series(scores, dtype="float64")

    return run(query, document)


def rerank(
    candidates: DataFrame,
    top_n: int = 5,
    scorer: ScorerFactory | None = None,
    query: str = "question",
    document: str = "text",
    key: str = "q_id",
) -> DataFrame:
    """Keep the ``top_n`` best scored candidates per query; equal scores stay in retrieval order.

    ``candidates`` has one row per (query, candidate) with the retrieval ``rank``; for a model they are dealt out over
    all cores.
    """
    if scorer is not None:
        candidates = over_all_cores(candidates)
    score = (
        word_overlap(F.col(query), F.col(document))
        if scorer is None
        else model_score(scorer, F.col(query), F.col(document))
    )
    scored = candidates.withColumnRenamed("rank", "first_rank").withColumn("rerank_score", score)
    return top_per_key(scored, [key], [F.col("rerank_score").desc(), F.col("first_rank")], top_n)


def pairs_of_lists(df: DataFrame, documents: str, document: str = "text") -> DataFrame:
    """One row per candidate from a list column, its position as ``rank``."""
    kept = [c for c in df.columns if c != documents]
    return df.select(*kept, F.posexplode(documents).alias("rank", document)).withColumn(
        "rank", F.col("rank").cast("long")
    )
