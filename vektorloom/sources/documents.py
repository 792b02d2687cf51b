"""Parsing documents into text blocks, and page names.

Parsers are user functions ``content -> blocks``; an HTML parser is supplied. PDF and picture
decoders plug in the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vektorloom.functions.text import page_image_name
from vektorloom.operators.spread import spread_small

ParserFactory = Callable[[], Callable[[object], list[dict]]]

# Elements that open a block, and elements whose text is not content.
BLOCK_TAGS = {"p": "paragraph", "li": "list_item", "td": "cell", "th": "cell", "pre": "code", "blockquote": "quote"}
HEADINGS = {"h1": 1, "h2": 2, "h3": 3, "h4": 4, "h5": 5, "h6": 6}
SKIPPED_TAGS = {"script", "style", "template", "noscript"}

#: Bytes of documents whose blocks a parsing task holds at once; a larger document is held alone.
PARSED_BYTES = 4 << 20


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.path: list[tuple[int, str]] = []
        self.kind, self.level, self.skipping = "text", 0, 0
        self.held: list[str] = []

    def flush(self, kind: str = "text", level: int = 0) -> None:
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            if self.kind == "heading":
                self.path = [h for h in self.path if h[0] < self.level]
            self.blocks.append({"kind": self.kind, "text": text, "heading_path": [h[1] for h in self.path]})
            if self.kind == "heading":
                self.path.append((self.level, text))
        self.kind, self.level = kind, level

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED_TAGS:
            self.skipping += 1
        elif tag in HEADINGS:
            self.flush("heading", HEADINGS[tag])
        elif tag == "title":
            self.flush("title")
        elif tag in BLOCK_TAGS:
            self.flush(BLOCK_TAGS[tag])
        elif tag in ("div", "article", "section", "table", "tr", "ul", "ol", "body", "nav", "main", "footer", "header"):
            self.flush()
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in SKIPPED_TAGS:
            self.skipping = max(0, self.skipping - 1)
        elif tag in HEADINGS or tag in BLOCK_TAGS or tag in ("title", "div", "article", "section", "body", "ul", "ol", "table"):
            self.flush()

    def handle_data(self, data):
        if not self.skipping:
            self.held.append(data)


def html_parser():
    """Block parser for HTML: kind, text and the headings above, in document order."""

    def parse(content) -> list[dict]:
        reader = _Blocks()
        reader.feed(content if isinstance(content, str) else bytes(content or b"").decode("utf-8", "replace"))
        reader.close()
        reader.flush()
        return reader.blocks

    return parse


def bounded_slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice has at most ``most_bytes`` in the column, or one row."""
    for batch in batches:
        values = batch.column(column)
        if not pa.types.is_binary(values.type) and not pa.types.is_string(values.type):
            values = values.cast(pa.large_binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def parse_documents(
    df: DataFrame, key: str, content: str, parser: ParserFactory = html_parser
) -> DataFrame:
    """``doc_id, block_idx, kind, heading_path, text`` of every document."""
    block = T.ArrayType(
        T.StructType(
            [
                T.StructField("kind", T.StringType()),
                T.StructField("heading_path", T.ArrayType(T.StringType())),
                T.StructField("text", T.StringType()),
            ]
        )
    )
    schema = T.StructType([T.StructField("doc_id", df.schema[key].dataType), T.StructField("blocks", block)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parse, out = parser(), to_arrow_schema(schema)
        for part in bounded_slices(batches, content, PARSED_BYTES):
            lists = [parse(c) if c is not None else [] for c in part.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(key).cast(out[0].type), pa.array(lists, out[1].type)], schema=out)

    parsed = spread_small(df.select(key, content)).mapInArrow(run, schema)
    return parsed.select("doc_id", F.posexplode("blocks").alias("block_idx", "_b")).select(
        "doc_id", F.col("block_idx").cast("long").alias("block_idx"), "_b.kind", "_b.heading_path", "_b.text"
    )


def parse_pages(files: DataFrame, parser: ParserFactory) -> DataFrame:
    """Text and figures per page of binary files.

    The parser returns dicts with ``page``, ``kind`` ('text' or 'figure'), ``text`` and ``data``.
    """
    schema = T.StructType(
        [
            T.StructField("path", T.StringType()),
            T.StructField("page", T.LongType()),
            T.StructField("item_idx", T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("text", T.StringType()),
            T.StructField("data", T.BinaryType()),
        ]
    )
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = parser()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                items = [{"path": path, "item_idx": i, "text": None, "data": None, **it} for i, it in enumerate(parse(content))]
                yield pd.DataFrame(items, columns=names)

    return spread_small(files.select("path", "content")).mapInPandas(run, schema)


def explode_pages(df: DataFrame, path: str, pages: str) -> DataFrame:
    """One row per page of a document, with the name of its rendered picture."""
    return df.select(path, F.posexplode(pages).alias("page_idx", "page")).select(
        path,
        F.col("page_idx").cast("long").alias("page_idx"),
        page_image_name(F.col(path), F.col("page_idx")).alias("image_name"),
        "page",
    )


def document_key(path: Column) -> Column:
    """Document id that does not collide between loads: a hash of the path."""
    return F.xxhash64(path)
