"""Answer-quality scores; ``labels`` gives verdicts, a document's source is the question."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.operators import scoring
from vektorloom.plans import evaluation
from vektorloom.session import scratch_path
from workload.registry import query, table
from workload.search import prototypes
from workload.texts import WORDS_SQL


def verdicts(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")


VERDICTS_SQL = "v AS (SELECT source, doc_id, quality, toxic FROM labels JOIN documents USING (doc_id))"


@query(f"WITH {VERDICTS_SQL} SELECT source, round(avg(quality), 6) AS context_recall FROM v GROUP BY source")
def context_recall(spark, sf):
    rows = scoring.context_recall(verdicts(spark, sf), "source", "quality")
    return rows.select("source", F.round("context_recall", 6).alias("context_recall"))


@query(f"WITH {VERDICTS_SQL} SELECT source, round(avg(1 - toxic), 6) AS faithfulness FROM v GROUP BY source")
def faithfulness(spark, sf):
    rows = scoring.faithfulness(verdicts(spark, sf).withColumn("supported", 1 - F.col("toxic")), "source")
    return rows.select("source", F.round("faithfulness", 6).alias("faithfulness"))


@query(
    f"""WITH {VERDICTS_SQL}, p AS (SELECT source, quality, avg(quality) OVER (PARTITION BY source ORDER BY doc_id) AS prec FROM v)
    SELECT source, round(coalesce(sum(prec * quality) / nullif(sum(quality), 0), 0), 6) AS context_precision
    FROM p GROUP BY source"""
)
def context_precision(spark, sf):
    rows = scoring.context_precision(verdicts(spark, sf), "source", "doc_id", "quality", 256)
    return rows.select("source", F.round("context_precision", 6).alias("context_precision"))


@query(
    f"""WITH {VERDICTS_SQL}, c AS (SELECT source, count(*) FILTER (quality = 1 AND toxic = 0) AS tp,
      count(*) FILTER (toxic = 1) AS fp, count(*) FILTER (quality = 0 AND toxic = 0) AS fn FROM v GROUP BY source)
    SELECT source, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS factual_f1 FROM c"""
)
def factual_f1(spark, sf):
    outcome = F.when(F.col("toxic") == 1, "FP").when(F.col("quality") == 1, "TP").otherwise("FN")
    rows = scoring.factual_f1(verdicts(spark, sf).withColumn("outcome", outcome), "source")
    return rows.select("source", F.round("factual_f1", 6).alias("factual_f1"))


@query(f"WITH {VERDICTS_SQL} SELECT source, round(avg(quality * 2 + (1 - toxic) * 2) / 4, 6) AS answer_accuracy FROM v GROUP BY source")
def answer_accuracy(spark, sf):
    rating = F.col("quality") * 2 + (1 - F.col("toxic")) * 2
    rows = scoring.answer_accuracy(verdicts(spark, sf).withColumn("rating", rating), "source")
    return rows.select("source", F.round("answer_accuracy", 6).alias("answer_accuracy"))


@query(
    """WITH p AS (SELECT label, list(m ORDER BY i) AS q FROM (
      SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS t(i) GROUP BY ALL) GROUP BY label)
    SELECT label, round(avg(list_inner_product(q, embedding::DOUBLE[]) / (sqrt(list_inner_product(q, q)) *
      sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS answer_relevancy
    FROM embeddings JOIN p USING (label) GROUP BY label"""
)
def answer_relevancy(spark, sf):
    asked = prototypes(spark, sf).select(F.col("q_id").alias("label"), F.col("vector").alias("question_vector"))
    generated = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("generated_vector"))
    rows = scoring.answer_relevancy(generated.join(asked, "label"), "label")
    return rows.select("label", F.round("answer_relevancy", 6).alias("answer_relevancy"))


def turn_pairs(spark, sf):
    """Each turn as the answer to the turn before it."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    answers = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    paired = turns.withColumnRenamed("text", "reference").join(answers, ["conv_id", "turn"])
    return paired.withColumn("q_id", F.concat("conv_id", F.lit("-"), "turn"))


@query(
    f"""WITH p AS (SELECT a.conv_id || '-' || a.turn AS q_id, {WORDS_SQL.format('b.text')} AS r, {WORDS_SQL.format('a.text')} AS t
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    g AS (SELECT q_id, n, r, t FROM p, (VALUES (1), (2)) AS o(n)),
    made AS (SELECT q_id, n, array_to_string(r[i : i + n - 1], ' ') AS gram, count(*) AS made
      FROM g, unnest(range(1, len(r) - n + 2)) AS x(i) GROUP BY ALL),
    given AS (SELECT q_id, n, array_to_string(t[i : i + n - 1], ' ') AS gram, count(*) AS given
      FROM g, unnest(range(1, len(t) - n + 2)) AS x(i) GROUP BY ALL),
    m AS (SELECT q_id, n, sum(least(made, coalesce(given, 0))) AS hit, sum(made) AS total
      FROM made LEFT JOIN given USING (q_id, n, gram) GROUP BY ALL),
    s AS (SELECT q_id, sum(CASE WHEN hit > 0 THEN ln(hit / total) END) AS logs, count(CASE WHEN hit > 0 THEN 1 END) AS orders
      FROM m GROUP BY q_id)
    SELECT p.q_id, round(coalesce(CASE WHEN orders = 2 THEN exp(logs / 2) * CASE WHEN len(r) > len(t) THEN 1
      ELSE exp(1 - len(t) / len(r)) END ELSE 0 END, 0), 6) AS bleu FROM p LEFT JOIN s USING (q_id)"""
)
def bleu(spark, sf):
    rows = scoring.bleu(turn_pairs(spark, sf))
    return rows.select("q_id", F.round("bleu", 6).alias("bleu"))


@query(
    f"""WITH {VERDICTS_SQL}, s AS (SELECT source, avg(quality) AS recall, avg(1 - toxic) AS faithful FROM v GROUP BY source)
    SELECT round(avg(recall), 6) AS context_recall, round(avg(faithful), 6) AS faithfulness FROM s"""
)
def metric_means(spark, sf):
    rows = verdicts(spark, sf).withColumn("supported", 1 - F.col("toxic"))
    scores = scoring.context_recall(rows, "source", "quality").join(scoring.faithfulness(rows, "source"), "source")
    means = scoring.metric_means(scores, ["context_recall", "faithfulness"])
    return means.select(*[F.round(c, 6).alias(c) for c in means.columns])


def judged_pairs(spark, sf):
    """Each turn as the reference of the turn after it, whose lines are the contexts."""
    return turn_pairs(spark, sf).select(
        "q_id",
        F.col("reference").alias("user_input"),
        "response",
        F.split("response", "\n").alias("retrieved_contexts"),
        "reference",
    )


def claims_sql(text: str) -> str:
    pieces = f"string_split_regex(coalesce({text}, ''), '[.!?\\n]')"
    return f"list_filter(list_transform({pieces}, lambda x: list_distinct({WORDS_SQL.format('x')})), lambda w: len(w) > 0)"


HELD_SQL = "len(list_filter({0}, lambda x: NOT list_contains({1}, x))) = 0"
SCORES_OF_PAIRS_SQL = f"""WITH p AS (SELECT a.conv_id || '-' || a.turn AS q_id, a.text AS t, b.text AS r,
      list_distinct({WORDS_SQL.format('a.text')}) AS wanted, list_distinct({WORDS_SQL.format('b.text')}) AS said,
      {claims_sql('a.text')} AS of_t, {claims_sql('b.text')} AS of_r,
      list_transform(string_split(b.text, chr(10)), lambda c: list_distinct({WORDS_SQL.format('c')})) AS contexts
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    v AS (SELECT q_id, wanted, said,
      list_transform(of_t, lambda c: CASE WHEN {HELD_SQL.format('c', 'said')} THEN 1 ELSE 0 END) AS supported,
      list_transform(of_r, lambda c: CASE WHEN {HELD_SQL.format('c', 'said')} THEN 1 ELSE 0 END) AS faithful,
      list_transform(contexts, lambda c: CASE WHEN len(wanted) > 0 AND 2 * len(list_intersect(c, wanted)) >= len(wanted)
        THEN 1 ELSE 0 END) AS relevant,
      len(list_filter(of_r, lambda c: {HELD_SQL.format('c', 'wanted')})) AS tp,
      len(list_filter(of_r, lambda c: NOT ({HELD_SQL.format('c', 'wanted')}))) AS fp,
      len(list_filter(of_t, lambda c: NOT ({HELD_SQL.format('c', 'said')}))) AS fn FROM p)
    SELECT q_id, round(list_avg(supported), 6) AS context_recall, round(list_avg(faithful), 6) AS faithfulness,
      round(CASE WHEN list_sum(relevant) = 0 THEN 0 ELSE list_sum(list_transform(range(1, len(relevant) + 1), lambda i:
        CASE WHEN relevant[i] = 1 THEN list_sum(relevant[1:i])::DOUBLE / i ELSE 0 END)) / list_sum(relevant) END, 6) AS context_precision,
      round(CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END, 6) AS factual_f1,
      CASE WHEN list_sort(wanted) = list_sort(said) THEN 1.0 WHEN len(list_intersect(wanted, said)) > 0 THEN 0.5 ELSE 0.0 END
        ::DOUBLE AS answer_accuracy FROM v"""
JUDGED_METRICS = ["context_recall", "faithfulness", "context_precision", "factual_f1", "answer_accuracy"]


@query(SCORES_OF_PAIRS_SQL)
def evaluate_rows(spark, sf):
    """Judged once, scored in the same plan, written as CSV and read back."""
    found = evaluation.evaluate_rows(judged_pairs(spark, sf), csv=scratch_path(spark, "scores"))
    return found.select("q_id", *[F.round(m, 6).alias(m) for m in JUDGED_METRICS])


@query(f"SELECT * FROM ({SCORES_OF_PAIRS_SQL}) ORDER BY q_id LIMIT 1")
def evaluate_one(spark, sf):
    """The scores of a single answer (the first by id)."""
    row = judged_pairs(spark, sf).orderBy("q_id").first()
    scores = evaluation.evaluate_one(spark, row.user_input, row.response, row.retrieved_contexts, row.reference, metrics=JUDGED_METRICS)
    return spark.createDataFrame([(row.q_id, *[scores[m] for m in JUDGED_METRICS])], ["q_id", *JUDGED_METRICS])
