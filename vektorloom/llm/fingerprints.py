"""Homomorphic fingerprints of texts as multisets of paragraphs, to which paragraphs can be added and taken away.

A paragraph is a non-empty line. Its vector has two parts, and a text's fingerprint is the sum of its paragraphs'
vectors, every component modulo ``2 ** 32``:

* ``lanes``: 32 components of 32 bits from 16 independently seeded hashes of the whole paragraph. Two texts have equal
  lanes if they have the same paragraphs equally often, in any order, and by accident with a chance of about
  ``2 ** -1024``. Other words, other word order or other white space make another paragraph.
* ``counts``: 64 components that count the paragraph's phrases by the bits of their hashes. They are a function of the
  paragraphs too, so they change no equality; twice a count less the number of phrases is a sum of random signs, so the
  cosine of two texts' counts estimates how much of their phrases they share. That is the likeness of texts whose
  paragraphs were edited.

The sums form a group: ``insert`` and ``delete`` are inverse to each other for all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektorloom.llm.common import settled

#: Every component counts modulo ``2 ** 32``.
MASK = (1 << 32) - 1
#: Independently seeded hashes of a paragraph; each gives two lanes.
SEEDS = 16
#: A phrase's hash has 64 bits; two of them are counted in one long (bit j and bit j + 32).
WORDS = 32
_ONES = 1 | 1 << 32

#: A phrase ends with a word of four or more characters, or with its paragraph.
PHRASE_END = r"(?<=\S{4})\s+|\n+"

#: Documents whose ids differ in the last SPAN bits only are put in order together.
SPAN = 8

#: So many keys one task may sort.
ONE_SORT = 100_000


def paragraph_lanes(paragraph: Column) -> Column:
    """The 32 lanes of one paragraph. The seed is hashed first, so that the hashes are independent."""
    hashes = F.array(*[F.xxhash64(F.lit(seed), paragraph) for seed in range(SEEDS)])
    return F.flatten(F.transform(hashes, lambda h: F.array(h.bitwiseAND(F.lit(MASK)), F.shiftrightunsigned(h, 32))))


def added(a: Column, b: Column, sign: int = 1) -> Column:
    """Component by component, modulo ``2 ** 32``."""
    return F.zip_with(a, b, lambda x, y: (x + F.lit(sign) * y).bitwiseAND(F.lit(MASK)))


def text_lanes(text: Column) -> Column:
    """The sum of the lanes of a text's paragraphs. Every step stays below ``2 ** 33``."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), 2 * SEEDS)
    paragraphs = F.filter(F.split(text, "\n"), lambda p: p != "")
    return F.aggregate(paragraphs, zero, lambda total, p: added(total, paragraph_lanes(p)))


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """``key`` columns, ``n`` (phrases), ``lanes`` and ``counts`` of each key's text, one row per key and text.

    Empty texts have no paragraphs and the zero vector; null texts count as empty. The phrases of a text are counted by
    partial sums; with fewer than ``2 ** 31`` of them (a text of Spark has no more) no sum leaves a long.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    # the lanes are a column before the text is cut up, else every phrase would compute them again
    cut = texts.select(*key, text_lanes(body).alias("lanes"), F.split(body, PHRASE_END).alias("phrases"))
    rows = cut.select(*key, "lanes", F.explode("phrases").alias("phrase"))
    one = (F.col("phrase") != "").cast("long")
    h = F.xxhash64("phrase")
    parts = [(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_ONES)) * F.col("one")).alias(f"w{j}") for j in range(WORDS)]
    sums = [F.sum(f"w{j}").alias(f"w{j}") for j in range(WORDS)]
    summed = rows.select(*key, "lanes", "phrase", one.alias("one")).select(*key, "lanes", "one", *parts)
    summed = summed.groupBy(*key, "lanes").agg(F.sum("one").alias("n"), *sums)
    low = [F.col(f"w{j}").bitwiseAND(F.lit(MASK)) for j in range(WORDS)]
    high = [F.shiftrightunsigned(F.col(f"w{j}"), 32) for j in range(WORDS)]
    return summed.select(*key, "n", "lanes", F.array(*low, *high).alias("counts"))


def combine(left: DataFrame, right: DataFrame, key: list[str], sign: int = 1) -> DataFrame:
    """Fingerprints of the texts of ``left`` with those of ``right`` inserted (``sign`` 1) or deleted (-1), key by key."""
    other = right.select(*key, *(F.col(c).alias(f"{c}_other") for c in ("n", "lanes", "counts")))
    both = left.join(other, key, "left")
    n = (F.col("n") + F.lit(sign) * F.col("n_other")).bitwiseAND(F.lit(MASK))
    new = {"n": n, **{c: added(F.col(c), F.col(f"{c}_other"), sign) for c in ("lanes", "counts")}}
    return both.select(*key, *[F.when(F.col("n_other").isNull(), F.col(c)).otherwise(e).alias(c) for c, e in new.items()])


def insert(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return combine(left, right, key, 1)


def delete(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    return combine(left, right, key, -1)


def as_text(n: str, lanes: str, counts: str) -> Column:
    """The fingerprint as a string: lanes, number of phrases and counts, in hexadecimal."""
    wide = F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), "")
    return F.lower(F.concat_ws(":", wide, F.hex(n), F.array_join(F.transform(counts, F.hex), ":")))


def likeness(a: Column, a_n: Column, b: Column, b_n: Column) -> Column:
    """Likeness of two fingerprints (counts and numbers of phrases), 0 to 1.

    Equal counts have likeness 1, an empty text has likeness 0 with any other.
    """

    def signed(counts: Column, n: Column) -> Column:
        return F.transform(counts, lambda x: (x * 2 - n).cast("double"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    x, y = signed(a, a_n), signed(b, b_n)
    length = F.sqrt(dot(x, x) * dot(y, y))
    cosine = F.when(length > 0, dot(x, y) / length).otherwise(F.lit(0.0))
    return F.when((a_n == b_n) & (a == b), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def next_key(keys: DataFrame) -> DataFrame:
    """Distinct longs ``k`` with the ``next`` larger one (null for the largest).

    Many keys are compared within spans of 2**16 values; the last of a span takes the first key of the next span that
    has any, which is found in the same way among the spans. So no task sorts more than ONE_SORT keys.
    """
    if keys.count() <= ONE_SORT:
        return keys.withColumn("next", F.lead("k").over(Window.partitionBy(F.lit(0)).orderBy("k")))
    spans = keys.withColumn("span", F.shiftright("k", 16))
    within = spans.withColumn("next", F.lead("k").over(Window.partitionBy("span").orderBy("k")))
    first = spans.groupBy("span").agg(F.min("k").alias("first"))
    after = next_key(first.select(F.col("span").alias("k"))).select(F.col("k").alias("span"), F.col("next").alias("after"))
    following = after.join(first.select(F.col("span").alias("after"), "first"), "after").select("span", "first")
    return within.join(following, "span", "left").select("k", F.coalesce("next", "first").alias("next"))


def edits(docs: DataFrame) -> DataFrame:
    """``span, row_no, next_span, next_row, doc_id, n_chars, text, edited`` of the documents that have an id.

    The last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document by
    ascending ``doc_id`` (ties by text); after the last comes the first. ``(span, row_no)`` names a row. The texts
    move once, to the other ids of their span; of other spans only the first text is needed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.where("doc_id IS NOT NULL").withColumn("span", F.shiftright("doc_id", SPAN))
    order = Window.partitionBy("span").orderBy("doc_id", "text")
    within = rows.withColumns({"row_no": F.row_number().over(order), "next_text": F.lead("text").over(order)})
    spans = settled(rows.select(F.col("span").alias("k")).distinct(), "spans")
    lowest = spans.agg(F.min("k")).first()[0]
    after = next_key(spans).select(F.col("k").alias("span"), F.coalesce("next", F.lit(lowest).cast("long")).alias("after"))
    firsts = rows.withColumn("row_no", F.row_number().over(order)).where("row_no = 1")
    following = after.join(firsts.select(F.col("span").alias("after"), F.col("text").alias("first_text")), "after")
    met = within.join(following, "span", "left")
    n, last = F.char_length("text"), F.col("next_text").isNull()
    half = F.floor(n / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", "first_text"), F.lit(1), half)
    )
    return met.select(
        "span",
        "row_no",
        F.when(last, F.col("after")).otherwise(F.col("span")).alias("next_span"),
        F.when(last, F.lit(1)).otherwise(F.col("row_no") + 1).alias("next_row"),
        "doc_id",
        n.cast("long").alias("n_chars"),
        "text",
        edited.alias("edited"),
    )


def _both_prints(rows: DataFrame) -> DataFrame:
    """Fingerprints of the texts and the edited texts of ``edits``, as arrays, and the edited texts' digests."""
    key = ["span", "row_no", "next_span", "next_row", "doc_id", "n_chars", "edited_sha256"]
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(c).alias("body")) for i, c in enumerate(("text", "edited")))))
    bodies = rows.withColumn("edited_sha256", F.sha2("edited", 256)).select(*key, sides.alias("of")).select(*key, "of.side", "of.body")
    prints = fingerprints(bodies, [*key, "side"], "body")

    def of_side(i: int, name: str) -> list[Column]:
        return [F.max(F.when(F.col("side") == i, F.col(c))).alias(f"{name}_{c}") for c in ("n", "lanes", "counts")]

    return prints.groupBy(*key).agg(*of_side(0, "own"), *of_side(1, "edited"))


def fingerprinted_edits(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Null texts count as empty. Of rows that repeat an id each has its place, in the order of their texts. A row
    without an id has no next document: its edited text is its first part alone and ``near_next`` is null. Other
    columns are not read. An empty table gives no rows.
    """
    n = F.char_length("text")
    no_id = docs.where("doc_id IS NULL").select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    no_id = no_id.select(
        F.lit(None).cast("long").alias("span"),
        F.monotonically_increasing_id().alias("row_no"),
        F.lit(None).cast("long").alias("next_span"),
        F.lit(None).cast("long").alias("next_row"),
        F.lit(None).cast("long").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        "text",
        F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")).alias("edited"),
    )
    prints = settled(_both_prints(edits(docs)).unionByName(_both_prints(no_id)), "fingerprints")
    following = prints.where("span IS NOT NULL").select(
        F.col("span").alias("next_span"),
        F.col("row_no").alias("next_row"),
        F.col("own_n").alias("next_n"),
        F.col("own_counts").alias("next_counts"),
    )
    own = F.col("own_counts"), F.col("own_n")
    near_next = likeness(*own, F.col("next_counts"), F.col("next_n"))
    return prints.join(following, ["next_span", "next_row"], "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text("own_n", "own_lanes", "own_counts").alias("fingerprint"),
        as_text("edited_n", "edited_lanes", "edited_counts").alias("edited_fingerprint"),
        likeness(*own, F.col("edited_counts"), F.col("edited_n")).alias("near_edited"),
        F.when(F.col("next_n").isNotNull(), near_next).alias("near_next"),
    )
