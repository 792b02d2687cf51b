"""Questions -> vectors -> retrieval -> reranking -> prompts -> answers -> evaluation rows."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vektorloom.collections.published import SharedFolder
from vektorloom.operators.embedding import EncoderFactory, embed
from vektorloom.operators.late_interaction import candidate_documents, max_sim
from vektorloom.operators.prompting import (
    ResponderFactory,
    chat_messages,
    echo_responder,
    evaluation_rows,
    gather_contexts,
    generate,
    prompts,
)
from vektorloom.operators.ranking import with_row_index
from vektorloom.operators.rerank import ScorerFactory, rerank
from vektorloom.operators.search import similarity_top_k
from vektorloom.operators.spread import send_if_small
from vektorloom.operators.stored_index import StoredIndex
from vektorloom.sources.tables import append_round_stats

#: Stages of a round, in order.
STAGES = ("embedding", "retrieval", "rerank", "prompt", "generation")


def retrieve(
    questions: DataFrame,
    collection: DataFrame | None,
    k: int = 10,
    metric: str = "cosine",
    encoder: EncoderFactory | None = None,
    item_keys: tuple[str, ...] = ("id",),
    fields: tuple[str, ...] = ("text",),
    index: StoredIndex | None = None,
    nprobe: int | None = None,
) -> DataFrame:
    """Best ``k`` items per question with their text; the question text is kept for reranking.

    With an ``index`` (which brings its metric, keys and stored fields) the collection is not read.
    """
    asked = embed(questions, "question", encoder)
    if index is None:
        found = similarity_top_k(asked, collection, k, metric, item_keys=item_keys, output_fields=fields)
    else:
        found = index.search(asked, k, nprobe, output_fields=fields)
    return found.join(questions.select("q_id", "question"), "q_id")


def answer(
    questions: DataFrame,
    collection: DataFrame | None = None,
    k: int = 10,
    top_n: int | None = 5,
    metric: str = "cosine",
    encoder: EncoderFactory | None = None,
    scorer: ScorerFactory | None = None,
    responder: ResponderFactory | None = None,
    item_keys: tuple[str, ...] = ("id",),
    index: StoredIndex | None = None,
    nprobe: int | None = None,
    **sampling,
) -> DataFrame:
    """Every question answered from its contexts, found by a scan of the collection or through an index; returns
    evaluation rows and the prompt."""
    hits = retrieve(questions, collection, k, metric, encoder, item_keys, index=index, nprobe=nprobe)
    if top_n is not None:
        hits = rerank(hits, top_n, scorer)
    asked = prompts(questions, gather_contexts(hits))
    answered = generate(asked, responder or echo_responder(), **sampling)
    return evaluation_rows(answered, extra=["prompt"])


def answer_in_rounds(
    questions: DataFrame,
    collection: DataFrame | None,
    batch_size: int,
    folder: str,
    k: int = 10,
    top_n: int | None = 5,
    metric: str = "cosine",
    encoder: EncoderFactory | None = None,
    scorer: ScorerFactory | None = None,
    responder: ResponderFactory | None = None,
    item_keys: tuple[str, ...] = ("id",),
    index: StoredIndex | None = None,
    nprobe: int | None = None,
    **sampling,
) -> tuple[DataFrame, DataFrame]:
    """Questions answered batch by batch, with the time of every stage of every round.

    Each stage's rows are written below ``folder`` and read by the next one, so its time is its own, and a round that is
    repeated after a failure takes up where it stopped. Returns the evaluation rows of all rounds and
    ``round, embedding, retrieval, rerank, prompt, generation, total`` in nanoseconds with each stage's share of its
    round in percent; the times are also appended to ``folder/rounds`` as tab-separated lines.
    """
    spark = questions.sparkSession
    numbered = with_row_index(questions, ["q_id"], "_row").withColumn("_round", F.floor(F.col("_row") / batch_size)).drop("_row")
    rounds = [r["_round"] for r in numbered.select("_round").distinct().orderBy("_round").collect()]
    stats = []
    for number in rounds:
        asked = numbered.where(F.col("_round") == number).drop("_round")
        times: dict[str, int] = {}

        def staged(name: str, rows: DataFrame) -> DataFrame:
            path = f"{folder}/round={number}/{name}"
            began = time.monotonic_ns()
            if not SharedFolder(spark, path).has("_SUCCESS"):
                rows.write.mode("overwrite").parquet(path)
            times[name] = time.monotonic_ns() - began
            return spark.read.schema(rows.schema).parquet(path)

        vectors = staged("embedding", embed(asked, "question", encoder))
        if index is None:
            found = similarity_top_k(vectors, collection, k, metric, item_keys=item_keys, output_fields=("text",))
        else:
            found = index.search(vectors, k, nprobe, output_fields=("text",))
        hits = staged("retrieval", found.join(asked.select("q_id", "question"), "q_id"))
        if top_n is not None:
            hits = staged("rerank", rerank(hits, top_n, scorer))
        prompted = staged("prompt", prompts(asked, gather_contexts(hits)))
        staged("generation", evaluation_rows(generate(prompted, responder or echo_responder(), **sampling), extra=["prompt"]))
        stats.append((number, *[times.get(c) for c in STAGES]))
    schema = ", ".join(["round long", *[f"{c} long" for c in STAGES]])
    per_round = spark.createDataFrame(stats, schema)  # one row per round, measured here
    append_round_stats(per_round, f"{folder}/rounds")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in STAGES[1:]), F.coalesce(F.col(STAGES[0]), F.lit(0)))
    shares = [F.try_divide(F.col(c) * 100.0, F.col("total")).alias(f"share_{c}") for c in STAGES]
    timed = per_round.withColumn("total", total).select("*", *shares)
    if not rounds:
        return answer(questions, collection, k, top_n, metric, encoder, scorer, responder, item_keys, index, nprobe, **sampling), timed
    answered = spark.read.parquet(*[f"{folder}/round={n}/generation" for n in rounds])
    return answered, timed


def retrieve_pages(
    tokens: DataFrame, rows: DataFrame, top_k: int = 2, per_token: int = 50, metric: str = "ip"
) -> DataFrame:
    """Page retrieval: candidates per token vector, then late interaction; with the page's file."""
    found = send_if_small(max_sim(tokens, rows, candidate_documents(tokens, rows, per_token, metric), top_k))
    named = rows.select("doc_id", "filepath").join(found, "doc_id")
    return named.groupBy("q_id", "doc_id", "score", "rank").agg(F.max("filepath").alias("filepath"))


def page_prompts(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Chat turn per question: page images by rank, then the question."""
    images = pages.groupBy("q_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "filepath"))).getField("filepath").alias("images")
    )
    joined = questions.join(images, "q_id", "left")
    shown = F.coalesce("images", F.array().cast("array<string>"))
    return joined.select("q_id", "question", chat_messages(F.col("question"), shown).alias("messages"))
