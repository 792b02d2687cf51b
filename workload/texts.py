"""Chunking, embedding, prompts and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.functions import text as tx
from vektorloom.functions.vectors import l2_norm
from vektorloom.operators import chunking, embedding, prompting
from vektorloom.sources import documents as docs
from vektorloom.sources import logs
from workload.registry import query, table

WORDS_SQL = r"regexp_extract_all(lower({0}), '[^ \t\r\n\f.,;:!?]+')"
BUCKET_SQL = "('0x' || substr(md5({0}), 1, 8))::UBIGINT % 64"


def chunks_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""SELECT doc_id, i AS chunk_idx, substr(text, i * {step} + 1, {size}) AS text
      FROM documents, unnest(range(0, greatest(ceil((length(text) - {overlap}) / {step}), 1)::BIGINT)) AS t(i)"""


@query(f"SELECT doc_id, chunk_idx, md5(text) AS text_md5, length(text) AS n_chars FROM ({chunks_sql(512, 64)})")
def chunk_fixed(spark, sf):
    chunks = chunking.fixed_length_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 512, 64)
    return chunks.select(
        "doc_id", "chunk_idx", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n_chars")
    )


@query(f"SELECT doc_id, count(*) AS n_chunks, sum(length(text))::BIGINT AS n_chars FROM ({chunks_sql(512, 0)}) GROUP BY 1")
def chunk_totals(spark, sf):
    chunks = chunking.fixed_length_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 512)
    return chunking.chunk_totals(chunks)


@query()
def chunk_recursive(spark, sf):
    return chunking.recursive_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 512, 0)


@query(
    r"""SELECT doc_id, md5(regexp_replace(text, '[ \t\r\n\f]+', '', 'g')) AS content_md5 FROM documents"""
)
def recursive_content(spark, sf):
    """Without overlap the chunks hold every character of the text except blanks."""
    chunks = chunking.recursive_chunks(table(spark, sf, "documents").select("doc_id", "text"), "text", 512, 0)
    whole = chunks.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("chunk_idx", "text"))).getField("text"), "").alias("text")
    )
    return whole.select("doc_id", F.md5(F.regexp_replace("text", r"[ \t\r\n\f]+", "")).alias("content_md5"))


@query()
def html_blocks(spark, sf):
    return docs.parse_documents(table(spark, sf, "pages"), "page_id", "html")


@query()
def block_chunks(spark, sf):
    return chunking.chunks_of_blocks(docs.parse_documents(table(spark, sf, "pages"), "page_id", "html"))


@query(
    """SELECT doc_id, 'doc' || doc_id || '_page_' || i || '.png' AS image_name, md5(part) AS page_md5 FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS part, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i
      FROM documents)"""
)
def page_images(spark, sf):
    pages = table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit("/corpus/doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"),
        F.split("text", "\n").alias("pages"),
    )
    exploded = docs.explode_pages(pages, "path", "pages")
    return exploded.select(
        tx.captured_int(F.col("path"), r"doc(\d+)").alias("doc_id"), "image_name", F.md5("page").alias("page_md5")
    )


@query("SELECT doc_id, md5(regexp_replace(text, '\\n+', chr(10), 'g')) AS text_md5 FROM documents")
def collapse_newlines(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.collapse_newlines(F.col("text"))).alias("text_md5")
    )


@query(
    f"""SELECT CAST(substr(source, 4) AS BIGINT) AS batch, len({WORDS_SQL.format('text')})::BIGINT AS token_size,
    count(*) AS n FROM documents GROUP BY ALL"""
)
def token_histogram(spark, sf):
    lines = table(spark, sf, "documents").select(
        F.concat(F.lit("wiki_batch_"), F.substring("source", 4, 10), F.lit(".log")).alias("file"),
        F.concat(F.lit("Max Token Size in Batch: "), F.size(tx.words(F.col("text"))).cast("string")).alias("line"),
    )
    sizes = lines.select(
        tx.captured_int(F.col("file"), logs.BATCH_FILE_PATTERN).alias("batch"),
        tx.captured_int(F.col("line"), logs.TOKEN_LINE_PATTERN).alias("token_size"),
    )
    return logs.token_histogram(sizes)


@query(
    """SELECT event_type AS tag, epoch_us(ts) * 1000 AS ts_ns, event_id FROM events"""
)
def stage_marks(spark, sf):
    from vektorloom.functions.units import epoch_us

    lines = table(spark, sf, "events").select(
        "event_id",
        F.concat("event_type", F.lit(", "), (epoch_us(F.col("ts")) * 1000).cast("string")).alias("value"),
    )
    noise = lines.select("event_id", F.lit("not a mark").alias("value"))
    return logs.parse_marks(lines.unionByName(noise))


@query(
    f"""WITH t AS (SELECT doc_id, unnest({WORDS_SQL.format('text')}) AS w FROM documents)
    SELECT doc_id, ({BUCKET_SQL.format('w')})::BIGINT AS dim, count(*)::DOUBLE AS n FROM t GROUP BY ALL"""
)
def embed_words(spark, sf):
    vectors = embedding.embed(table(spark, sf, "documents").select("doc_id", "text"))
    return vectors.select("doc_id", F.posexplode("vector").alias("dim", "n")).where("n > 0").select(
        "doc_id", F.col("dim").cast("long").alias("dim"), F.col("n").cast("double").alias("n")
    )


@query(
    """SELECT vec_id AS doc_id, s AS seq_id,
      round(list_sum(list_transform(embedding[s * 16 + 1 : s * 16 + 16], lambda x: x::DOUBLE)), 4) AS total
    FROM embeddings, unnest(range(0, 4)) AS t(s)"""
)
def multi_vector_rows(spark, sf):
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(F.col("embedding"), i * 16 + 1, 16)
    )
    documents = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), parts.alias("vectors"))
    rows = embedding.explode_vectors(documents, "doc_id", "vectors")
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return rows.select("doc_id", "seq_id", F.round(total, 4).alias("total"))


@query(
    """WITH n AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
    SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_inner_product(v, v)))), 4) AS total,
    round(1.0, 4) AS norm FROM n"""
)
def l2_normalize(spark, sf):
    doubled = table(spark, sf, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x * 2).cast("float")).alias("vector")
    )
    rows = embedding.normalised(doubled)
    total = F.aggregate("vector", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return rows.select("vec_id", F.round(total, 4).alias("total"), F.round(l2_norm("vector"), 4).alias("norm"))


PROMPT_SQL = (
    "replace(replace(replace(replace('" + prompting.PROMPT_LAYOUT.replace("'", "''")
    + "', '{n_ctx}', n_ctx), '{ctx_fmt}', '" + tx.CONTEXT_LAYOUT
    + "'), '{contexts_combined}', contexts), '{question}', question)"
)


@query(
    f"""WITH c AS (SELECT conv_id AS q_id, count(*)::VARCHAR AS n_ctx, arg_min(text, turn) AS question,
      string_agg('Source #' || turn || chr(10) || 'Detail: ' || text || chr(10), chr(10) ORDER BY turn) AS contexts
      FROM conversations GROUP BY conv_id)
    SELECT q_id, md5({PROMPT_SQL}) AS prompt_md5, length({PROMPT_SQL}) AS n_chars FROM c"""
)
def context_prompt(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("q_id"), F.col("turn").alias("rank"), "text")
    questions = turns.groupBy("q_id").agg(F.min_by("text", "rank").alias("question"))
    asked = prompting.prompts(questions, prompting.gather_contexts(turns))
    return asked.select("q_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


@query(
    """SELECT conv_id, md5(to_json(list({'role': role, 'content': text} ORDER BY turn))::VARCHAR) AS messages_md5
    FROM conversations GROUP BY conv_id"""
)
def chat_template(spark, sf):
    turns = prompting.chat_turns(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")
    return turns.select("conv_id", F.md5("messages").alias("messages_md5"))


@query(
    """WITH c AS (SELECT conv_id AS q_id, list(conv_id || '_page_' || (turn + 1) || '.png' ORDER BY turn) AS images,
      arg_min(text, turn) AS question FROM conversations GROUP BY conv_id)
    SELECT q_id, md5('[{"role":"user","content":[' || array_to_string(list_transform(images,
      lambda i: '{"type":"image","image":"' || i || '"}'), ',') || ',{"type":"text","text":' ||
      to_json(question)::VARCHAR || '}]}]') AS messages_md5 FROM c"""
)
def image_chat(spark, sf):
    from vektorloom.plans.answering import page_prompts

    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("q_id"), F.col("turn").alias("rank"), "text")
    name = tx.page_image_name(F.concat(F.lit("/p/"), F.col("q_id").cast("string"), F.lit(".pdf")), F.col("rank"))
    questions = turns.groupBy("q_id").agg(F.min_by("text", "rank").alias("question"))
    asked = page_prompts(questions, turns.select("q_id", "rank", name.alias("filepath")))
    return asked.select("q_id", F.md5(F.to_json("messages")).alias("messages_md5"))


@query("SELECT item_id AS q_id, text AS response FROM benchmark")
def generate_answers(spark, sf):
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("q_id"), F.concat(F.lit("User's question: "), F.regexp_replace("text", "\n", " "), F.lit("\nEnd")).alias("prompt")
    )
    answered = prompting.generate(asked, prompting.echo_responder())
    return answered.select("q_id", F.regexp_replace("response", " ", "\n").alias("response"))
