"""Answer-quality scores from verdict tables.

A judge (a user function) writes one row per claim, context or rating; Spark turns those rows into
scores. Claim verdicts are averaged with partial aggregation; the position-aware precision uses
sliced running sums, so a question with very many contexts is not gathered in one task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektorloom.functions.text import words
from vektorloom.functions.vectors import cosine
from vektorloom.operators.series import running_sums
from vektorloom.operators.spread import over_all_cores, spread_small

JudgeFactory = Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]


def judge(rows: DataFrame, factory: JudgeFactory, schema: str) -> DataFrame:
    """Verdict rows from a user judge over batches of evaluation rows, dealt out over all cores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        assess = factory()
        for batch in batches:
            yield assess(batch)

    return over_all_cores(rows).mapInPandas(run, schema)


def verdict_share(verdicts: DataFrame, key: str, verdict: str, name: str) -> DataFrame:
    """Supported claims over all claims."""
    return verdicts.groupBy(key).agg(F.avg(F.col(verdict).cast("double")).alias(name))


def context_recall(verdicts: DataFrame, key: str = "q_id", verdict: str = "supported") -> DataFrame:
    """Share of the reference's claims that the contexts support."""
    return verdict_share(verdicts, key, verdict, "context_recall")


def faithfulness(verdicts: DataFrame, key: str = "q_id", verdict: str = "supported") -> DataFrame:
    """Share of the answer's claims that the contexts support."""
    return verdict_share(verdicts, key, verdict, "faithfulness")


def context_precision(
    verdicts: DataFrame, key: str = "q_id", rank: str = "rank", relevant: str = "relevant", width: int = 65_536
) -> DataFrame:
    """Sum of precision at each relevant position over the number of relevant contexts; 0 if none."""
    counts = {"_seen": F.lit(1).cast("long"), "_found": F.col(relevant).cast("long")}
    found = running_sums(verdicts, [key], [rank], counts, width)
    precision = F.col("_found") / F.col("_seen") * F.col(relevant)
    return found.groupBy(key).agg(
        F.coalesce(F.try_divide(F.sum(precision), F.sum(F.col(relevant).cast("double"))), F.lit(0.0)).alias(
            "context_precision"
        )
    )


def answer_relevancy(
    generated: DataFrame, key: str = "q_id", question: str = "question_vector", other: str = "generated_vector"
) -> DataFrame:
    """Mean cosine between the question and the questions generated back from the answer."""
    return generated.groupBy(key).agg(F.avg(cosine(question, other)).alias("answer_relevancy"))


def factual_f1(claims: DataFrame, key: str = "q_id", outcome: str = "outcome") -> DataFrame:
    """F1 over claims marked TP, FP or FN; 0 without a true positive."""
    def counted(mark: str):
        return F.sum(F.when(F.col(outcome) == mark, 1.0).otherwise(0.0))

    counts = claims.groupBy(key).agg(counted("TP").alias("tp"), counted("FP").alias("fp"), counted("FN").alias("fn"))
    score = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select(key, F.coalesce(score, F.lit(0.0)).alias("factual_f1"))


def answer_accuracy(ratings: DataFrame, key: str = "q_id", rating: str = "rating") -> DataFrame:
    """Mean of judge ratings 0, 2 or 4, scaled to 0..1."""
    return ratings.groupBy(key).agg((F.avg(F.col(rating).cast("double")) / 4.0).alias("answer_accuracy"))


def clipped_precision(made: Sequence[str], given: Sequence[str], n: int) -> float:
    """Share of the n-grams of one word list that the other one covers, each as often as it holds it."""
    ours = Counter(zip(*(made[i:] for i in range(n))))
    theirs = Counter(zip(*(given[i:] for i in range(n))))
    return (ours & theirs).total() / max(ours.total(), 1)


def bleu(
    pairs: DataFrame, key: str = "q_id", response: str = "response", reference: str = "reference", max_n: int = 2
) -> DataFrame:
    """BLEU per row: clipped n-gram precision, geometric mean, brevity penalty. Whole texts.

    All n-grams of a pair come from its own row, so they are counted inside the row; grouping
    exploded n-grams instead would shuffle several times the volume of the texts.
    """

    rows = spread_small(pairs.select(key, response, reference))
    return rows.select(key, bleu_scores(F.col(response), F.col(reference), max_n).alias("bleu"))


def bleu_scores(response: Column, reference: Column, max_n: int = 2) -> Column:
    """BLEU of two texts; a NULL text has no words."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for responses, references in batches:
            scores = []
            for made, given in zip(responses.map(list), references.map(list)):
                shares = [clipped_precision(made, given, n) for n in range(1, max_n + 1)]
                if min(shares) == 0:
                    scores.append(0.0)
                    continue
                penalty = 1.0 if len(made) > len(given) else math.exp(1 - len(given) / len(made))
                scores.append(math.exp(sum(map(math.log, shares)) / max_n) * penalty)
            yield pd.Series(scores, dtype="float64")

    empty = F.array().cast("array<string>")
    return score(*(F.coalesce(words(c), empty) for c in (response, reference)))


def metric_means(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row with the mean of every metric."""
    return scores.agg(*[F.avg(m).alias(m) for m in metrics])
