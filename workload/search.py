"""Similarity search, late interaction, indexes, reranking and question answering."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.operators import chunking, embedding
from vektorloom.operators.index import Cells, ProductCodes, ScalarCodes, coded_top_k, probe_top_k
from vektorloom.operators.late_interaction import (
    candidate_documents,
    document_cells,
    fetch_documents,
    max_sim,
    reaching_documents,
)
from vektorloom.operators.ranking import best_overall, top_per_key, with_row_index
from vektorloom.operators.rerank import rerank
from vektorloom.operators.search import hit_report, rescored, search_batches, similarity_top_k
from vektorloom.plans.answering import answer, page_prompts, retrieve, retrieve_pages
from vektorloom.session import scratch_path
from workload.registry import query, table
from workload.texts import BUCKET_SQL, PROMPT_SQL, WORDS_SQL, chunks_sql


def prototypes(spark, sf):
    """Query vectors over the whole table: the mean vector of every label."""
    means = embedding.mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding")
    return means.select(F.col("label").alias("q_id"), F.col("embedding").alias("vector"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


PROTOTYPES_SQL = """proto AS (SELECT q_id, list(m ORDER BY i) AS q FROM (
      SELECT label AS q_id, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, 65)) AS t(i)
      GROUP BY label, i) GROUP BY q_id),
    pairs AS (SELECT q_id, q, vec_id AS id, embedding::DOUBLE[] AS v FROM proto, embeddings)"""
SCORES_SQL = {
    "l2": "list_inner_product(q, q) + list_inner_product(v, v) - 2 * list_inner_product(q, v)",
    "ip": "list_inner_product(q, v)",
    "cosine": "list_inner_product(q, v) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(v, v)))",
}


def knn_sql(metric: str, k: int = 10) -> str:
    order = "score" if metric == "l2" else "score DESC"
    return f"""WITH {PROTOTYPES_SQL}
    SELECT q_id, id, score, rn - 1 AS rank FROM (
      SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY {order}, id) AS rn
      FROM (SELECT q_id, id, round({SCORES_SQL[metric]}, 6) AS score FROM pairs)) WHERE rn <= {k}"""


def register_knn(metric: str) -> None:
    @query(knn_sql(metric), name=f"knn_{metric}")
    def run(spark, sf):
        return similarity_top_k(prototypes(spark, sf), vectors(spark, sf), 10, metric)


for _metric in ("l2", "ip", "cosine"):
    register_knn(_metric)


@query(knn_sql("l2"))
def knn_grid(spark, sf):
    """The plan for two large sides; same rows as the scan."""
    return similarity_top_k(prototypes(spark, sf), vectors(spark, sf), 10, "l2", strategy="grid")


@query(
    f"""WITH {PROTOTYPES_SQL}, first AS (SELECT q_id, q, id, v FROM pairs
      QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round({SCORES_SQL['l2']}, 6), id) <= 100)
    SELECT q_id, id, score, rn - 1 AS rank FROM (
      SELECT q_id, id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rn
      FROM (SELECT q_id, id, round({SCORES_SQL['cosine']}, 6) AS score FROM first)) WHERE rn <= 10"""
)
def knn_overfetch(spark, sf):
    asked, items = prototypes(spark, sf), vectors(spark, sf)
    candidates = similarity_top_k(asked, items, 100, "l2")
    return rescored(candidates, asked, items, 10, "cosine")


@query(
    """SELECT (rn - 1) // 16 AS batch, count(*) AS n FROM (
      SELECT row_number() OVER (ORDER BY item_id) AS rn FROM benchmark) GROUP BY 1"""
)
def query_batches(spark, sf):
    questions = with_row_index(table(spark, sf, "benchmark").select("item_id"), ["item_id"])
    batches = search_batches(questions, "row_idx", 16, questions.count())
    return batches.groupBy("batch").agg(F.count("*").alias("n"))


@query(
    """WITH d AS (SELECT vec_id, i - 1 AS dim, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) AS t(i)),
    r AS (SELECT dim, min(x) AS low, max(x) AS high FROM d GROUP BY dim)
    SELECT vec_id AS id, dim, CAST(floor((x - low) / (high - low) * 255 + 0.5) AS BIGINT) AS code FROM d JOIN r USING (dim)"""
)
def scalar_quantize(spark, sf):
    items = vectors(spark, sf)
    coded = ScalarCodes.train(items).encode(items)
    return coded.select("id", F.posexplode("codes").alias("dim", "code")).select(
        "id", F.col("dim").cast("long").alias("dim"), F.col("code").cast("long").alias("code")
    )


@query(knn_sql("l2"))
def sq_search(spark, sf):
    items = vectors(spark, sf)
    codes = ScalarCodes.train(items)
    return coded_top_k(prototypes(spark, sf), codes.encode(items), codes, items, 10, "l2")


@query()
def pq_search(spark, sf):
    items = vectors(spark, sf)
    codes = ProductCodes.train(items, 32, bits=8)
    return coded_top_k(prototypes(spark, sf), codes.encode(items), codes, items, 10, "l2", over_fetch=20)


@query()
def ivf_probe(spark, sf):
    items = vectors(spark, sf)
    cells = Cells.train(items, "l2", 16, iterations=10)
    return probe_top_k(prototypes(spark, sf), cells.assign(items), cells, 10, nprobe=12)


@query(knn_sql("l2"))
def ivf_all_cells(spark, sf):
    """Probing every cell gives the exact answer."""
    items = vectors(spark, sf)
    cells = Cells.train(items, "l2", 16, iterations=10)
    return probe_top_k(prototypes(spark, sf), cells.assign(items), cells, 10, nprobe=16)


# ---- texts ------------------------------------------------------------------


def text_collection(spark, sf):
    """All documents as embedded chunks."""
    chunks = chunking.fixed_length_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 512, 64)
    return embedding.embed(chunks).withColumnRenamed("chunk_idx", "seq_id")


def stored_collection(spark, sf):
    """The collection written once, for plans that read it more than once."""
    path = scratch_path(spark, "chunks")
    text_collection(spark, sf).drop("text").write.parquet(path)
    return spark.read.parquet(path)


def questions_of(spark, sf):
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("q_id"), F.col("text").alias("question"), F.lit("").alias("reference")
    )


def question_tokens(spark, sf):
    """One vector per line of every question."""
    lines = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("q_id"), F.posexplode(F.split("text", "\n")).alias("q_seq", "text")
    )
    return embedding.embed(lines.withColumn("q_seq", F.col("q_seq").cast("long"))).drop("text")


def counts_sql(name: str, source: str, keys: str) -> str:
    """Sparse word-bucket counts and their length as CTEs."""
    return f"""{name}_w AS (SELECT {keys}, unnest({WORDS_SQL.format('text')}) AS w FROM {source}),
    {name}_c AS (SELECT {keys}, {BUCKET_SQL.format('w')} AS b, count(*)::DOUBLE AS c FROM {name}_w GROUP BY ALL),
    {name}_n AS (SELECT {keys}, sqrt(sum(c * c)) AS norm FROM {name}_c GROUP BY ALL)"""


TEXT_HITS_SQL = f"""chunk AS ({chunks_sql(512, 64)}),
    question AS (SELECT item_id AS q_id, text FROM benchmark),
    {counts_sql('d', 'chunk', 'doc_id, chunk_idx')},
    {counts_sql('q', 'question', 'q_id')},
    dots AS (SELECT q_id, doc_id, chunk_idx, sum(q_c.c * d_c.c) AS dot FROM q_c JOIN d_c USING (b) GROUP BY ALL),
    hits AS (SELECT q_id, doc_id, chunk_idx, score, rn - 1 AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id, chunk_idx) AS rn FROM (
        SELECT q_id, doc_id, chunk_idx, round(dot / (q_n.norm * d_n.norm), 6) AS score
        FROM dots JOIN q_n USING (q_id) JOIN d_n USING (doc_id, chunk_idx))) WHERE rn <= 10)"""


@query(
    f"""WITH {TEXT_HITS_SQL}
    SELECT q_id, rank, doc_id, chunk_idx, round(score::DECIMAL(18, 6), 4)::DOUBLE AS score, length(text) AS text_length
    FROM hits JOIN chunk USING (doc_id, chunk_idx)"""
)
def retrieval_report(spark, sf):
    hits = retrieve(questions_of(spark, sf), text_collection(spark, sf), 10, "cosine", item_keys=("doc_id", "seq_id"))
    report = hit_report(hits.withColumn("item", F.struct("doc_id", "seq_id")), item_key="item")
    return report.select("q_id", "rank", "item.doc_id", F.col("item.seq_id").alias("chunk_idx"), "score", "text_length")


RERANKED_SQL = f"""{TEXT_HITS_SQL},
    scored AS (SELECT h.*, chunk.text, question.text AS question, len(list_intersect(
        list_distinct({WORDS_SQL.format('question.text')}), list_distinct({WORDS_SQL.format('chunk.text')})))::DOUBLE AS overlap
      FROM hits h JOIN chunk USING (doc_id, chunk_idx) JOIN question USING (q_id)),
    kept AS (SELECT * EXCLUDE (rank), rank AS first_rank, row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, rank) - 1 AS rank
      FROM scored QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY overlap DESC, rank) <= 5)"""


@query(f"WITH {RERANKED_SQL} SELECT q_id, rank, first_rank, doc_id, chunk_idx, overlap FROM kept")
def rerank_overlap(spark, sf):
    hits = retrieve(questions_of(spark, sf), text_collection(spark, sf), 10, "cosine", item_keys=("doc_id", "seq_id"))
    return rerank(hits, 5).select(
        "q_id", "rank", "first_rank", "doc_id", F.col("seq_id").alias("chunk_idx"), F.col("rerank_score").alias("overlap")
    )


@query(
    f"""WITH {RERANKED_SQL},
    c AS (SELECT q_id, any_value(question) AS question, count(*)::VARCHAR AS n_ctx, string_agg('Source #' || rank || chr(10)
      || 'Detail: ' || text || chr(10), chr(10) ORDER BY rank) AS contexts FROM kept GROUP BY q_id)
    SELECT q_id, question AS user_input, trim(split_part(question, chr(10), 1)) AS response, n_ctx::BIGINT AS n_contexts,
      md5({PROMPT_SQL}) AS prompt_md5 FROM c"""
)
def answer_questions(spark, sf):
    answered = answer(
        questions_of(spark, sf), text_collection(spark, sf), 10, 5, "cosine", item_keys=("doc_id", "seq_id")
    )
    return answered.select(
        "q_id",
        "user_input",
        "response",
        F.size("retrieved_contexts").cast("long").alias("n_contexts"),
        F.md5("prompt").alias("prompt_md5"),
    )


TOKENS_SQL = f"""chunk AS ({chunks_sql(512, 64)}),
    token AS (SELECT item_id AS q_id, unnest(range(0, len(string_split(text, chr(10))))) AS q_seq,
      unnest(string_split(text, chr(10))) AS text FROM benchmark),
    {counts_sql('d', 'chunk', 'doc_id, chunk_idx')},
    {counts_sql('q', 'token', 'q_id, q_seq')},
    dots AS (SELECT q_id, q_seq, doc_id, chunk_idx, sum(q_c.c * d_c.c) AS dot FROM q_c JOIN d_c USING (b) GROUP BY ALL),
    candidate AS (SELECT DISTINCT q_id, doc_id FROM (SELECT q_id, doc_id FROM dots
      QUALIFY row_number() OVER (PARTITION BY q_id, q_seq ORDER BY dot DESC, doc_id, chunk_idx) <= 50))"""


@query(f"WITH {TOKENS_SQL} SELECT q_id, doc_id FROM candidate")
def candidate_docs(spark, sf):
    return candidate_documents(question_tokens(spark, sf), text_collection(spark, sf), 50)


@query(
    f"""WITH {TOKENS_SQL}
    SELECT doc_id, count(*) AS n_rows FROM chunk WHERE doc_id IN (SELECT doc_id FROM candidate) GROUP BY doc_id"""
)
def candidate_rows(spark, sf):
    rows = stored_collection(spark, sf)
    kept = fetch_documents(rows, candidate_documents(question_tokens(spark, sf), rows, 50))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_rows"))


MAXSIM_SQL = f"""WITH {TOKENS_SQL},
    best AS (SELECT q_id, doc_id, q_seq, max(dot) AS best FROM dots SEMI JOIN candidate USING (q_id, doc_id) GROUP BY ALL),
    total AS (SELECT q_id, doc_id, round(sum(best), 6) AS score FROM best GROUP BY ALL)
    SELECT q_id, doc_id, score, rn - 1 AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rn FROM total) WHERE rn <= 5"""


@query(MAXSIM_SQL)
def maxsim(spark, sf):
    tokens, rows = question_tokens(spark, sf), stored_collection(spark, sf)
    return max_sim(tokens, rows, candidate_documents(tokens, rows, 50), 5)


@query(MAXSIM_SQL)
def maxsim_pruned(spark, sf):
    """Exact scores only for documents that their cells leave in the race."""
    tokens, rows = question_tokens(spark, sf), stored_collection(spark, sf)
    cells = Cells.train(rows, "ip", 64, iterations=5)
    candidates = candidate_documents(tokens, rows, 50)
    return max_sim(tokens, rows, reaching_documents(tokens, document_cells(rows, cells), cells, candidates, 5), 5)


@query(
    f"""WITH {TOKENS_SQL},
    best AS (SELECT q_id, doc_id, q_seq, max(dot) AS best FROM dots SEMI JOIN candidate USING (q_id, doc_id) GROUP BY ALL),
    total AS (SELECT q_id, doc_id, round(sum(best), 6) AS score FROM best GROUP BY ALL),
    top AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rn FROM total),
    images AS (SELECT q_id, string_agg('{{"type":"image","image":"doc' || doc_id || '.png"}}', ',' ORDER BY rn) AS images
      FROM top WHERE rn <= 2 GROUP BY q_id)
    SELECT item_id AS q_id, md5('[{{"role":"user","content":[' || images || ',{{"type":"text","text":' ||
      to_json(text)::VARCHAR || '}}]}}]') AS messages_md5 FROM benchmark JOIN images ON item_id = q_id"""
)
def page_answers(spark, sf):
    """Two best pages per question by late interaction, as a chat turn."""
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".png"))
    pages = retrieve_pages(question_tokens(spark, sf), stored_collection(spark, sf).withColumn("filepath", name), 2)
    asked = page_prompts(questions_of(spark, sf), pages)
    return asked.select("q_id", F.md5(F.to_json("messages")).alias("messages_md5"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def longest_documents(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "n_chars")
    return best_overall(rows, [F.col("n_chars").desc(), F.col("doc_id")], 20)


@query(
    """SELECT label, vec_id, rank, score FROM (SELECT label, vec_id, score,
      row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) - 1 AS rank FROM (
        SELECT label, vec_id, round(list_max(embedding)::DOUBLE, 6) AS score FROM embeddings)) WHERE rank < 3"""
)
def label_peaks(spark, sf):
    """Best vectors per label by their largest component."""
    from vektorloom.functions.vectors import row_max

    rows = table(spark, sf, "embeddings").select(
        "label", "vec_id", F.round(row_max("embedding").cast("double"), 6).alias("score")
    )
    return top_per_key(rows, ["label"], [F.col("score").desc(), F.col("vec_id")], 3)
