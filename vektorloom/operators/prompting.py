"""Prompts, batch generation and the evaluation table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vektorloom.operators.spread import over_all_cores
from vektorloom.functions.text import CONTEXT_LAYOUT, format_context

# Fixed value: the instruction text around the contexts and the question.
PROMPT_LAYOUT = """
                        First, check if the provided Context is relevant to the user's question.
                        Second, only if the provided Context is strongly relevant, answer the question using the Context.
                        Otherwise, if the Context is not strongly relevant, IGNORE THEM COMPLETELY and answer the question from your own knowledge. You MUST NOT say anything about relevence or missing information or say phrase like 'the text does not discuss'.
                        There are totally {n_ctx} contexts, each in format of "{ctx_fmt}"
                        Context: {contexts_combined}
                        User's question: {question}
                        Your answer starts from here
                        """

# Sampling defaults handed to the model.
SAMPLING = {"temperature": 0.7, "top_p": 0.9, "max_tokens": 1024}

ResponderFactory = Callable[[], Callable[[Sequence[str], dict], Sequence[str]]]


def filled(layout: str, values: dict[str, Column]) -> Column:
    """A column from a layout with ``{name}`` places."""
    parts: list[Column] = []
    rest = layout
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def gather_contexts(hits: DataFrame, key: str = "q_id", text: str = "text", rank: str = "rank") -> DataFrame:
    """Formatted contexts per query in rank order. A query has at most k hits, so lists stay short."""
    blocks = hits.select(key, F.struct(rank, format_context(F.col(rank), F.col(text)).alias("block")).alias("_hit"))
    return blocks.groupBy(key).agg(F.array_sort(F.collect_list("_hit")).getField("block").alias("contexts"))


def prompts(questions: DataFrame, contexts: DataFrame, key: str = "q_id") -> DataFrame:
    """One prompt per question; questions without a hit get an empty context list."""
    joined = questions.join(contexts, key, "left").withColumn(
        "contexts", F.coalesce("contexts", F.array().cast("array<string>"))
    )
    prompt = filled(
        PROMPT_LAYOUT,
        {
            "n_ctx": F.size("contexts").cast("string"),
            "ctx_fmt": F.lit(CONTEXT_LAYOUT),
            "contexts_combined": F.array_join("contexts", "\n"),
            "question": F.col("question"),
        },
    )
    return joined.withColumn("prompt", prompt)


_PART = "struct<type:string,image:string,text:string>"


def chat_messages(question: Column, images: Column) -> Column:
    """One user turn: the images in order, then the question."""
    pictures = F.transform(
        images,
        lambda image: F.struct(
            F.lit("image").alias("type"), image.alias("image"), F.lit(None).cast("string").alias("text")
        ).cast(_PART),
    )
    asked = F.struct(
        F.lit("text").alias("type"), F.lit(None).cast("string").alias("image"), question.alias("text")
    ).cast(_PART)
    return F.array(
        F.struct(F.lit("user").alias("role"), F.concat(pictures, F.array(asked)).alias("content"))
    )


def chat_turns(df: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """Conversation rows -> one ordered list of role/content structs as JSON."""
    turn = F.struct(F.col(order).alias("_at"), F.col(role).alias("role"), F.col(text).alias("content"))
    lists = df.groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    messages = F.transform(
        "_turns", lambda t: F.struct(t.getField("role").alias("role"), t.getField("content").alias("content"))
    )
    return lists.select(key, F.to_json(messages).alias("messages"))


def echo_responder() -> ResponderFactory:
    """Stand-in model: answers with the last line of text in the prompt that asks the question."""

    def load():
        def answer(batch: Sequence[str], sampling: dict) -> list[str]:
            mark = "User's question: "
            return [p.rpartition(mark)[2].partition("\n")[0].strip() for p in batch]

        return answer

    return load


def generate(
    df: DataFrame,
    responder: ResponderFactory,
    prompt: str = "prompt",
    name: str = "response",
    batch_size: int = 64,
    **sampling,
) -> DataFrame:
    """Add a model answer per row. Rows are dealt out over all cores, the model is loaded once per worker, answer
    counts are checked."""
    settings = {**SAMPLING, **sampling}
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.StringType())])

    def run(batches):
        respond = responder()
        for batch in batches:
            answers: list[str] = []
            for low in range(0, len(batch), batch_size):
                part = batch[prompt].iloc[low : low + batch_size].tolist()
                got = list(respond(part, settings))
                if len(got) != len(part):
                    raise ValueError(f"{len(got)} responses for {len(part)} prompts")
                answers += got
            yield batch.assign(**{name: pd.Series(answers, index=batch.index, dtype="object")})

    return over_all_cores(df).mapInPandas(run, schema)


def evaluation_rows(answered: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The table a judge reads: question, answer, contexts and reference answer."""
    return answered.select(
        "q_id",
        F.col("question").alias("user_input"),
        "response",
        F.col("contexts").alias("retrieved_contexts"),
        "reference",
        *extra,
    )
