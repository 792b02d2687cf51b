"""Sources, collections, filters and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from vektorloom.collections.store import Collections, pair_rows, unpaired
from vektorloom.functions import text as tx
from vektorloom.functions.units import epoch_us
from vektorloom.operators.embedding import dimension, split_valid
from vektorloom.operators.ranking import latest_per_key, with_batch_number, with_row_index
from vektorloom.operators.telemetry import moving_series, only_members
from vektorloom.session import scratch_path
from vektorloom.sources import files, tables
from workload.registry import query, table


@query("SELECT md5(text) AS content_md5, CAST(doc_id AS VARCHAR) AS metadata FROM documents")
def corpus_scan(spark, sf):
    corpus = tables.read_corpus(spark, f"{sf}/documents.parquet", key="doc_id")
    return corpus.select(F.md5("content").alias("content_md5"), "metadata")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def page_slice(spark, sf):
    return tables.corpus_page(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 50, 2)


@query(
    """SELECT doc_id, n_chars FROM documents
    QUALIFY row_number() OVER (ORDER BY doc_id) <= floor((SELECT count(*) FROM documents) * 0.1)"""
)
def ratio_head(spark, sf):
    return tables.corpus_share(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", 0.1)


@query("SELECT item_id AS q_id, text AS question FROM benchmark ORDER BY item_id LIMIT 16 OFFSET 8")
def question_batch(spark, sf):
    questions = tables.read_questions(spark, f"{sf}/benchmark.parquet", "item_id", "text", None)
    return tables.question_batch(questions, 16, 8).select("q_id", "question")


@query(
    """SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dim, round(embedding[1]::DOUBLE, 6) AS first_value,
    round(embedding[64]::DOUBLE, 6) AS last_value FROM embeddings"""
)
def stored_embeddings(spark, sf):
    rows = tables.read_embeddings(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    return rows.select(
        "id",
        F.size("vector").cast("long").alias("dim"),
        F.round(F.col("vector")[0].cast("double"), 6).alias("first_value"),
        F.round(F.element_at("vector", -1).cast("double"), 6).alias("last_value"),
    )


@query(
    """SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_idx FROM conversations"""
)
def row_ids(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn")
    return with_row_index(rows, ["conv_id", "turn"])


@query(
    """SELECT (rn - 1) // 64 AS batch, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id
    FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1"""
)
def insert_batches(spark, sf):
    numbered = with_row_index(table(spark, sf, "events").select("event_id"), ["event_id"])
    return (
        with_batch_number(numbered, "row_idx", 64)
        .groupBy("batch")
        .agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    )


@query(
    """SELECT 'documents_text' AS collection, count(*) AS n_rows FROM documents
    UNION ALL SELECT 'vectors', count(*) FROM embeddings"""
)
def collection_counts(spark, sf):
    store = Collections(spark, scratch_path(spark, "collections"), "counts")
    vectors = table(spark, sf, "embeddings")
    texts = table(spark, sf, "documents")
    store.create("vectors", 64)
    store.insert_rows("vectors", vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    store.create("documents_text", 1)
    store.insert_rows(
        "documents_text",
        texts.select(F.col("doc_id").alias("id"), "text", F.array(F.col("n_chars").cast("float")).alias("vector")),
    )
    return store.row_counts()


@query(
    """SELECT lang, source, count(*) AS n_pairs, sum(quality) AS n_good FROM documents JOIN labels USING (doc_id)
    GROUP BY lang, source"""
)
def strict_pairs(spark, sf):
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    paired = pair_rows(documents.select("doc_id", "lang", "source"), labels.select("doc_id", "quality"), "doc_id")
    return paired.groupBy("lang", "source").agg(
        F.count("*").alias("n_pairs"), F.sum("quality").cast("long").alias("n_good")
    )


@query(
    """SELECT (SELECT count(*) FROM documents d ANTI JOIN labels l USING (doc_id)) AS only_left,
    (SELECT count(*) FROM labels l ANTI JOIN documents d USING (doc_id)) AS only_right"""
)
def unpaired_rows(spark, sf):
    return unpaired(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    """SELECT 'document' AS kind, doc_id AS id, md5(text) AS text_md5 FROM documents
    UNION ALL SELECT 'question', item_id, md5(text) FROM benchmark
    UNION ALL SELECT 'page', page_id, md5(html) FROM pages"""
)
def append_records(spark, sf):
    """Three tables appended to one collection, one after another."""
    store = Collections(spark, scratch_path(spark, "appended"), "appended")
    store.create("records", 1)
    for name, kind, key, text in (
        ("documents", "document", "doc_id", "text"),
        ("benchmark", "question", "item_id", "text"),
        ("pages", "page", "page_id", "html"),
    ):
        rows = table(spark, sf, name).select(
            F.col(key).cast("string").alias("id"),
            F.col(text).alias("text"),
            F.array(F.lit(1.0)).alias("vector"),
            F.create_map(F.lit("kind"), F.lit(kind)).alias("payload"),
        )
        store.insert_rows("records", rows)
    return store.scan("records").select(
        F.col("payload")["kind"].alias("kind"), F.col("id").cast("long").alias("id"), F.md5("text").alias("text_md5")
    )


@query(
    """SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def upsert_latest(spark, sf):
    rows = latest_per_key(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])
    return rows.select("user_id", "event_id", "event_type", "value")


@query(
    """WITH c AS (SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x)
      OR isinf(x))) = 0 AS ok, label FROM embeddings)
    SELECT label, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_rejected FROM c GROUP BY label"""
)
def vector_validity(spark, sf):
    good, bad = split_valid(table(spark, sf, "embeddings"), 64, "embedding")
    marked = good.select("label", F.lit(1).alias("ok")).unionByName(bad.select("label", F.lit(0).alias("ok")))
    return marked.groupBy("label").agg(
        F.sum("ok").alias("n_valid"), F.sum(1 - F.col("ok")).alias("n_rejected")
    )


@query(
    """SELECT min(len(embedding))::BIGINT AS min_dim, max(len(embedding))::BIGINT AS max_dim, count(*) AS n_rows
    FROM embeddings"""
)
def embedding_dim(spark, sf):
    return dimension(table(spark, sf, "embeddings"), "embedding")


@query("SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars BETWEEN 500 AND 5000")
def filter_project(spark, sf):
    store = Collections(spark, scratch_path(spark, "filtered"), "filtered")
    store.create("corpus", 1)
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.array(F.lit(1.0)).alias("vector"),
        F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("payload"),
        F.col("n_chars").alias("version"),
    )
    store.insert_rows("corpus", rows)
    found = store.query("corpus", "payload['lang'] = 'en' AND version BETWEEN 500 AND 5000", ["id", "payload", "version"])
    return found.select(
        F.col("id").cast("long").alias("doc_id"), F.col("payload")["source"].alias("source"), F.col("version").alias("n_chars")
    )


@query(
    """SELECT event_id, user_id, event_type FROM events
    WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)"""
)
def device_members(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    chosen = events.where("event_type = 'error' AND value > 100")
    return only_members(events.drop("value"), chosen.distinct(), ["user_id"])


@query(
    """SELECT event_id, user_id, event_type, value FROM events e
    SEMI JOIN (SELECT user_id, event_type FROM events GROUP BY ALL HAVING max(value) > 0) m
    USING (user_id, event_type)"""
)
def moving_devices(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return moving_series(events, ["user_id", "event_type"], "value").select(
        "event_id", "user_id", "event_type", "value"
    )


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def set_difference(spark, sf):
    wanted = table(spark, sf, "documents").select("doc_id", "source")
    return files.not_yet_fetched(wanted, table(spark, sf, "labels"), "doc_id")


@query(
    """SELECT folder, CAST(epoch(strptime(folder, '%Y-%m-%dT%H:%M:%S+0000')) AS BIGINT) AS started_s, n_events FROM (
      SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') || '+0000' AS folder, count(*) AS n_events
      FROM events GROUP BY 1)"""
)
def run_folders(spark, sf):
    stamped = table(spark, sf, "events").select(
        F.concat(F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")).alias("folder")
    )
    counted = stamped.groupBy("folder").agg(F.count("*").alias("n_events"))
    runs = files.runs_by_age(stamped)
    return runs.join(counted, "folder").select("folder", F.unix_seconds("started").alias("started_s"), "n_events")


@query(
    """SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '+0000' AS folder FROM events"""
)
def latest_run(spark, sf):
    stamped = table(spark, sf, "events").select(
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0000")).alias("folder")
    )
    return files.latest_run(stamped).select("folder")


@query(
    """WITH p AS (SELECT page_id, split_part(url, '?', 1) || '.v' || page_id || '.html' AS path FROM pages),
    b AS (SELECT page_id, path, list_last(string_split(path, '/')) AS base FROM p)
    SELECT page_id, base, regexp_replace(base, '\\.[^.]*$', '') AS stem, regexp_extract(base, '\\.[^.]*$') AS extension,
      left(path, length(path) - length(base) - 1) AS folder,
      regexp_replace(base, '\\.[^.]*$', '') || '_page_' || (page_id + 1) || '.png' AS image_name FROM b"""
)
def path_parts(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.concat(
            F.substring_index("url", "?", 1), F.lit(".v"), F.col("page_id").cast("string"), F.lit(".html")
        ).alias("path"),
    )
    path = F.col("path")
    return pages.select(
        "page_id",
        tx.base_name(path).alias("base"),
        tx.stem(path).alias("stem"),
        tx.extension(path).alias("extension"),
        tx.directory_name(path).alias("folder"),
        tx.page_image_name(path, F.col("page_id")).alias("image_name"),
    )


@query("SELECT doc_id, 'https://arxiv.org/pdf/' || source || '/' || doc_id AS url FROM documents")
def paper_urls(spark, sf):
    abstract = F.concat(F.lit("https://arxiv.org/abs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", tx.paper_pdf_url(abstract).alias("url"))


@query("SELECT page_id, lower(regexp_replace(url, '[^A-Za-z0-9_]+', '_', 'g')) AS name FROM pages")
def sanitize_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.index_name(tx.collection_name(F.col("url"))).alias("name"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.nested_value(F.col("props"), "k").cast("long").alias("k"))


@query("SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k_sum FROM events GROUP BY 1")
def json_lines(spark, sf):
    parsed = table(spark, sf, "events").select("event_type", tx.json_fields(F.col("props"), "k long").alias("p"))
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("k_sum"))


@query("SELECT page_id, md5(html) AS md5, sha256(html) AS sha256, length(html) AS n_chars FROM pages")
def content_hashes(spark, sf):
    html = F.col("html")
    return table(spark, sf, "pages").select(
        "page_id",
        tx.content_hash(html).alias("md5"),
        tx.content_hash(html, "sha256").alias("sha256"),
        F.length(html).cast("long").alias("n_chars"),
    )


@query("SELECT event_id, epoch_us(ts) AS us, value * 0.5 / 1024 AS mb, value / 1073741824.0 AS gib FROM events")
def unit_values(spark, sf):
    from vektorloom.functions.units import bytes_to_gib, sectors_to_mb

    return table(spark, sf, "events").select(
        "event_id",
        epoch_us(F.col("ts")).alias("us"),
        sectors_to_mb(F.col("value")).alias("mb"),
        bytes_to_gib(F.col("value")).alias("gib"),
    )
