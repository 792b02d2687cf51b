"""Text, naming and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The layout of one retrieved context.
CONTEXT_LAYOUT = "Source #{source_idx}\nDetail: {source_detail}\n"

#: A word is a run of characters without blanks and sentence marks (same set in every regex engine).
WORD_PATTERN = r"[^ \t\r\n\f.,;:!?]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def format_context(rank: Column, text: Column) -> Column:
    """One context block; ``rank`` counts from 0."""
    return F.concat(F.lit("Source #"), rank.cast("string"), F.lit("\nDetail: "), text, F.lit("\n"))


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\n+", "\n")


def collection_name(name: Column) -> Column:
    """Each run of characters other than letters, digits and underscore becomes one underscore."""
    return F.regexp_replace(name, r"(?U)[^\w]+", "_")


def index_name(name: Column) -> Column:
    return F.lower(name)


def paper_pdf_url(url: Column) -> Column:
    """Abstract page of a preprint server -> its PDF."""
    return F.replace(url, F.lit("arxiv.org/abs/"), F.lit("arxiv.org/pdf/"))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_name(path: Column) -> Column:
    """Everything before the last slash; empty without one."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    """Base name without its last extension (a leading dot is no extension)."""
    return F.regexp_replace(base_name(path), r"(?s)(.)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Last extension with its dot, or an empty string."""
    return F.regexp_extract(base_name(path), r"(?s).(\.[^.]*)$", 1)


def page_image_name(path: Column, page_index: Column) -> Column:
    """File name of a rendered page; ``page_index`` counts from 0."""
    return F.concat(stem(path), F.lit("_page_"), (page_index + 1).cast("string"), F.lit(".png"))


def captured_int(text: Column, pattern: str, group: int = 1) -> Column:
    """Integer captured by a regular expression; NULL without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("long")


def nested_value(json_text: Column, path: str) -> Column:
    """Value at a dotted path of a JSON string; whole-number keys index arrays."""
    steps = "".join(f"[{key}]" if key.lstrip("-").isdigit() else f".{key}" for key in path.split("."))
    return F.get_json_object(json_text, f"${steps}")


def json_fields(json_text: Column, schema: str) -> Column:
    """Parse JSON lines into a struct of the named fields only."""
    return F.from_json(json_text, schema)


def content_hash(content: Column, algorithm: str = "md5") -> Column:
    if algorithm == "md5":
        return F.md5(content)
    if algorithm.startswith("sha"):
        return F.sha2(content, int(algorithm[3:]))
    raise ValueError(f"unknown hash {algorithm!r}")
