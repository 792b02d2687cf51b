"""Corpora, questions and stored embeddings as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vektorloom.operators.ranking import between_positions, head_share, page

#: source tag -> Spark reader format
READERS = {
    "default": "parquet",
    "pdf": "binaryFile",
    "html": "text",
    "json": "json",
    "csv": "csv",
}


def read_tagged(spark: SparkSession, path: str, tag: str = "default", **options) -> DataFrame:
    """Read files by source tag. PDF files come as bytes, HTML as one whole text per file."""
    name = tag.lower()
    if name not in READERS:
        raise ValueError(f"unknown source tag {tag!r}; use one of {sorted(READERS)}")
    extra = {
        "pdf": {"pathGlobFilter": "*.pdf"},
        "html": {"wholetext": "true"},
        "csv": {"header": "true"},
    }.get(name, {})
    return spark.read.format(READERS[name]).options(**{**extra, **options}).load(path)


def read_corpus(spark: SparkSession, path: str, key: str = "id", text: str = "text") -> DataFrame:
    """Documents as ``content, metadata``; only these two columns are read."""
    return spark.read.parquet(path).select(F.col(text).alias("content"), F.col(key).cast("string").alias("metadata"))


def corpus_page(df: DataFrame, key: str, length: int, offset: int) -> DataFrame:
    """Page number ``offset`` of the corpus."""
    return page(df, key, length, offset)


def corpus_share(df: DataFrame, key: str, ratio: float) -> DataFrame:
    """Leading share of the corpus."""
    return head_share(df, key, ratio)


def read_questions(
    spark: SparkSession, path: str, key: str = "q_id", question: str = "query", answer: str | None = "answer"
) -> DataFrame:
    """Question set as ``q_id, question, reference``."""
    reference = F.col(answer) if answer else F.lit(None).cast("string")
    return spark.read.parquet(path).select(
        F.col(key).alias("q_id"), F.col(question).alias("question"), reference.alias("reference")
    )


def question_batch(questions: DataFrame, batch_size: int, start: int = 0, key: str = "q_id") -> DataFrame:
    """``batch_size`` questions from position ``start``; an empty frame past the end."""
    return between_positions(questions, key, start, start + batch_size)


def read_embeddings(spark: SparkSession, path: str, key: str = "id", vector: str = "vector") -> DataFrame:
    return spark.read.parquet(path).select(F.col(key).alias("id"), F.col(vector).alias("vector"))


def write_embeddings(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Evaluation results as CSV with a header."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


# Columns of one line of round statistics, in nanoseconds.
ROUND_COLUMNS = ("round", "embedding", "retrieval", "rerank", "prompt", "generation", "total")


def append_round_stats(df: DataFrame, path: str) -> None:
    """Tab-separated stage times, one line per round, appended."""
    stages = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ROUND_COLUMNS[1:-1]]
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ROUND_COLUMNS[2:-1]), F.coalesce(F.col("embedding"), F.lit(0)))
    df.select("round", *stages, total.cast("long").alias("total")).write.mode("append").option("sep", "\t").csv(path)
