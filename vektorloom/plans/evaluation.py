"""Evaluation rows -> verdicts of a judge -> all answer scores, in one plan without a shuffle of verdicts.

An evaluation row holds everything a judge reads, so the judge's verdicts stay lists beside it and every score is an
expression over these lists. The judge is called on batches; a row on which it fails gets NULL scores and the error.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.functions.text import WORD_PATTERN
from vektorloom.operators.embedding import EncoderFactory, word_count_encoder
from vektorloom.operators.prompting import evaluation_rows
from vektorloom.operators.scoring import bleu_scores, metric_means
from vektorloom.operators.spread import over_all_cores
from vektorloom.sources.tables import write_scores

#: What a judge says about one row. Claims and contexts are judged in their order; ``questions`` are questions to which
#: the answer could be the response.
VERDICTS = T.StructType(
    [
        T.StructField("supported", T.ArrayType(T.IntegerType())),  # claims of the reference, by the contexts
        T.StructField("faithful", T.ArrayType(T.IntegerType())),  # claims of the response, by the contexts
        T.StructField("relevant", T.ArrayType(T.IntegerType())),  # contexts, by rank
        T.StructField("outcomes", T.ArrayType(T.StringType())),  # claims as TP, FP or FN
        T.StructField("ratings", T.ArrayType(T.IntegerType())),  # 0, 2 or 4
        T.StructField("questions", T.ArrayType(T.StringType())),
    ]
)
METRICS = ("context_recall", "context_precision", "faithfulness", "answer_relevancy", "factual_f1", "answer_accuracy", "bleu")

#: called once per Python worker; rows (dicts of an evaluation row) -> one dict of verdicts, or None, per row
JudgeFactory = Callable[[], Callable[[Sequence[dict]], Sequence[dict | None]]]


def overlap_judge() -> JudgeFactory:
    """Model-free default. Claims are the pieces between ``.!?`` and line ends; a text holds a claim if it has all its
    words; a context is relevant if it has half of the reference's words."""

    def load():
        find = re.compile(WORD_PATTERN).findall

        def words(text: str | None) -> set[str]:
            return set(find((text or "").lower()))

        def claims(text: str | None) -> list[set[str]]:
            return [w for w in map(words, re.split(r"[.!?\n]", text or "")) if w]

        def assess(row: dict) -> dict:
            contexts = [words(c) for c in row["retrieved_contexts"] or []]
            known, wanted, said = set().union(*contexts), words(row["reference"]), words(row["response"])
            of_reference, of_response = claims(row["reference"]), claims(row["response"])
            return {
                "supported": [int(c <= known) for c in of_reference],
                "faithful": [int(c <= known) for c in of_response],
                "relevant": [int(bool(wanted) and 2 * len(c & wanted) >= len(wanted)) for c in contexts],
                "outcomes": ["TP" if c <= wanted else "FP" for c in of_response] + ["FN" for c in of_reference if not c <= said],
                "ratings": [4 if wanted == said else 2 if wanted & said else 0],
                "questions": [row["response"] or ""],
            }

        return lambda rows: [assess(r) for r in rows]

    return load


def judged(rows: DataFrame, judge: JudgeFactory | None = None, encoder: EncoderFactory | None = None, batch_size: int = 64) -> DataFrame:
    """The rows with ``verdicts``, ``answer_relevancy`` (mean cosine of the question and the questions given back) and
    ``error``. A failing batch is tried row by row, so that one bad row does not take the others along."""
    make_judge, make_encoder = judge or overlap_judge(), encoder or word_count_encoder()
    extra = [T.StructField("verdicts", VERDICTS), T.StructField("answer_relevancy", T.DoubleType()), T.StructField("error", T.StringType())]
    schema = T.StructType([*rows.schema.fields, *extra])

    def one_by_one(assess, part: list[dict]) -> list[tuple[dict | None, str | None]]:
        try:
            found = list(assess(part))
            if len(found) != len(part):
                raise ValueError(f"{len(found)} verdicts for {len(part)} rows")
            return [(v, None if v is not None else "no verdict") for v in found]
        except Exception as failed:
            if len(part) == 1:
                return [(None, f"{type(failed).__name__}: {failed}")]
        return [found for row in part for found in one_by_one(assess, [row])]

    def relevancy(encode, row: dict, verdict: dict | None) -> float | None:
        asked = (verdict or {}).get("questions")
        if not asked:
            return None
        vectors = np.asarray(encode([row["user_input"] or "", *asked]), dtype=np.float64)
        lengths = np.linalg.norm(vectors, axis=1)
        if not lengths.all():
            return None
        return float((vectors[1:] @ vectors[0] / (lengths[1:] * lengths[0])).mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, assess, encode = to_arrow_schema(schema), make_judge(), make_encoder()
        for batch in batches:
            for low in range(0, batch.num_rows, batch_size):
                part = batch.slice(low, batch_size).to_pylist()
                for row, (verdict, error) in zip(part, one_by_one(assess, part)):
                    row.update(verdicts=verdict, error=error, answer_relevancy=relevancy(encode, row, verdict))
                yield pa.RecordBatch.from_pylist(part, schema=out)

    return over_all_cores(rows).mapInArrow(run, schema)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda t, x: t + x.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values))


def _precision(relevant: Column) -> Column:
    """Mean precision at the relevant positions; 0 if there is none."""
    start = F.struct(F.lit(0).alias("seen"), F.lit(0).alias("found"), F.lit(0.0).alias("total"))

    def step(at: Column, hit: Column) -> Column:
        seen, found = at.seen + 1, at.found + hit
        return F.struct(seen.alias("seen"), found.alias("found"), (at.total + F.when(hit == 1, found / seen).otherwise(0.0)).alias("total"))

    last = F.aggregate(relevant, start, step)
    return F.when(F.size(relevant) > 0, F.coalesce(F.try_divide(last.total, last.found), F.lit(0.0)))


def _f1(outcomes: Column) -> Column:
    count = lambda mark: F.size(F.filter(outcomes, lambda o: o == mark))
    score = F.try_divide(2.0 * count("TP"), 2 * count("TP") + count("FP") + count("FN"))
    return F.when(F.size(outcomes) > 0, F.coalesce(score, F.lit(0.0)))


def scores(rows: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Judged rows with one column per metric. A metric without anything to judge, or whose judge failed, is NULL."""
    if unknown := set(metrics) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}; use some of {METRICS}")
    v = F.col("verdicts")
    values = {
        "context_recall": _mean(v.supported),
        "context_precision": _precision(v.relevant),
        "faithfulness": _mean(v.faithful),
        "answer_relevancy": F.col("answer_relevancy"),
        "factual_f1": _f1(v.outcomes),
        "answer_accuracy": _mean(v.ratings) / 4.0,
        "bleu": bleu_scores(F.col("response"), F.col("reference")),
    }
    kept = [c for c in rows.columns if c not in ("verdicts", "answer_relevancy", "error")]
    return rows.select(*kept, *[values[m].alias(m) for m in metrics], "error")


def evaluate_rows(
    rows: DataFrame,
    judge: JudgeFactory | None = None,
    encoder: EncoderFactory | None = None,
    metrics: Sequence[str] = METRICS,
    csv: str | None = None,
) -> DataFrame:
    """Scores of evaluation rows (``q_id, user_input, response, retrieved_contexts, reference`` and any others). With
    ``csv`` they are written there and read back, so the judge runs once."""
    found = scores(judged(rows, judge, encoder), metrics)
    if csv is None:
        return found
    write_scores(found, csv)
    return read_scores(rows.sparkSession, csv, found.schema)


def read_scores(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scores as ``write_scores`` has written them; lists were written as JSON."""
    nested = {f.name: f.dataType for f in schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in schema])
    text = spark.read.schema(flat).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return text.select([F.from_json(f.name, nested[f.name]).alias(f.name) if f.name in nested else f.name for f in schema])


def evaluate_one(
    spark: SparkSession,
    question: str,
    answer: str,
    contexts: Sequence[str],
    reference: str,
    judge: JudgeFactory | None = None,
    encoder: EncoderFactory | None = None,
    metrics: Sequence[str] = METRICS,
) -> dict:
    """Scores of one answer."""
    row = spark.createDataFrame(
        [(0, question, answer, list(contexts), reference)],
        "q_id long, user_input string, response string, retrieved_contexts array<string>, reference string",
    )
    return evaluate_rows(row, judge, encoder, metrics).select(*metrics).first().asDict()


def evaluate_answers(answered: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Scores of answered questions (see ``answer``) and the mean of each metric."""
    rows = answered if "user_input" in answered.columns else evaluation_rows(answered)
    found = evaluate_rows(rows, **options)
    return found, metric_means(found, [c for c in METRICS if c in found.columns])
