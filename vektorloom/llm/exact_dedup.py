"""Exact deduplication by recipes of content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektorloom.llm.common import join_groups, settled

#: A chunk ends with the first sentence or line end after SHORTEST characters, or after LONGEST characters.
SHORTEST, LONGEST = 256, 2048


def chunks_of(text: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """The text cut at places that its content defines. The chunks put together are the text."""
    pattern = f"(?s).{{{shortest},{longest}}}?[.!?\\n]\\s|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(docs: DataFrame, key_of=F.xxhash64) -> DataFrame:
    """``doc_id, row_no, text_sha256, keys, digests``: per document its chunks' short keys and SHA-256 digests, in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("chunks", chunks_of(F.col("text")))
    return cut.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_no"),
        F.sha2("text", 256).alias("text_sha256"),
        F.transform("chunks", lambda c: key_of(c)).alias("keys"),
        F.transform("chunks", lambda c: F.unhex(F.sha2(c, 256))).alias("digests"),
    )


def keys_hold(written: DataFrame) -> bool:
    """True if each short key stands for one chunk only, by the digests of all chunks."""
    pair = F.explode(F.arrays_zip("keys", "digests")).alias("pair")
    distinct = written.select(pair).select("pair.keys", "pair.digests").distinct()
    return distinct.groupBy("keys").count().where("count > 1").isEmpty()


def exact_groups(docs: DataFrame, key_of=F.xxhash64) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Only chunk identifiers travel, not texts: every document becomes the ordered list of its chunks' 64-bit keys. The
    keys are first verified against the chunks' SHA-256 digests over the whole corpus; if one key stood for two
    chunks, the digests themselves are the identifiers. Documents are equal when their lists are. The row with the
    largest ``doc_id`` stays.

    A null text counts as empty; empty texts are copies of each other. Of rows that repeat both id and text one is
    kept. Rows without an id stay only if no copy has one. Other columns of ``docs`` are not read. An empty table
    gives no rows.
    """
    written = settled(recipes(docs, key_of), "recipes")
    ids = F.col("keys") if keys_hold(written) else F.transform("digests", F.hex)
    listed = written.select("doc_id", "row_no", "text_sha256", ids.alias("ids"))
    groups = settled(
        listed.groupBy("ids").agg(
            F.max("doc_id").alias("keep_id"),
            F.coalesce(F.max_by("row_no", "doc_id"), F.max("row_no")).alias("keep_row"),
            F.count("*").alias("group_size"),
        ),
        "equal-texts",
    )
    return join_groups(listed, groups, "ids", "group_size").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_no") == F.col("keep_row")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_groups`` keeps; the texts move once.

    Of rows that repeat both id and text the first met stays.
    """
    kept = exact_groups(docs).where("kept").select(_key("doc_id", F.col("text_sha256")).alias("_key"))
    rows = docs.select(
        _key("doc_id", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("_key"), F.struct(*docs.columns).alias("_row")
    )
    one = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    met = rows.join(kept, "_key", "left_semi").withColumn("_nr", one)
    return met.where("_nr = 1").select("_row.*")


def _key(doc_id: str, digest: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("none")), digest)
