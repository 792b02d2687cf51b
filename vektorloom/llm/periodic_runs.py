"""Periodic runs of words, found with a dictionary of basic factors.

A run is a stretch of words with smallest period ``q`` that has at least ``LEAST_WORDS`` words and ``LEAST_TIMES``
periods and that no neighbouring word extends. For every length ``m`` = 1, 2, 4, ... each factor of ``m`` words looks at
its next occurrence. If that begins within ``m`` words (both lie in a window of twice the length), their distance ``d``
is proposed as a period. Factors that follow each other with one distance form a stretch of period ``d``: from the
first of them to the end of the last one's next occurrence.

Why nothing is lost or added: in a run of period ``q`` any factor of ``m >= q`` words recurs after exactly ``q`` words,
because its first ``q`` words are primitive and so occur only at multiples of ``q``. With the ``m`` between ``q`` and
``2 * q`` a run of three periods holds such a factor and its successor, and all places of the run that do are
neighbours. So the stretch cannot be extended, and a stretch of three times its distance has no smaller period. The
same run is found again at longer lengths, hence it is made unique at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektorloom.llm.common import raw_texts, sized_slices
from vektorloom.llm.factors import joined, repeated_factors

LEAST_WORDS, LEAST_TIMES = 24, 3

#: Bytes of text that are searched together; a longer text is searched alone.
SLICE_BYTES = 8 << 20

WORD = r"[^\x20\x09-\x0D]+"

RUN = "struct<start: bigint, length: bigint, period: bigint>"


def runs_of(words: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and periods of all runs in ``words`` (see ``joined``); ``longest``: words of the longest text."""
    found = [np.empty((0, 3), np.int64)]
    for length, places, names in repeated_factors(words, max(1, 2 * longest // LEAST_TIMES)):
        step = np.diff(places)
        near = (names[1:] == names[:-1]) & (step <= length)
        at, step = places[:-1][near], step[near]
        order = np.lexsort((at, step))
        at, step = at[order], step[order]
        if not len(at):
            continue
        begins = np.append(True, (step[1:] != step[:-1]) | (at[1:] != at[:-1] + 1))
        last = at[np.append(begins[1:], True)]
        start, period = at[begins], step[begins]
        size = last + period + length - start
        whole = size >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        found.append(np.column_stack((start, period, size))[whole])
    out = np.unique(np.concatenate(found), axis=0)
    return out[:, 0], out[:, 2], out[:, 1]


def kept_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: not those that a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    return np.cumsum(edges[:-1]) == 0


def with_runs(
    docs: DataFrame, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words", carried: list[str] | None = None
) -> DataFrame:
    """``docs`` (or its columns ``carried``) with the runs of a text (start, length and period in words, sorted by start and period), its words
    without the repeats (joined by one space) and its number of words.

    Null and empty texts have no words, no runs and an empty collapsed text. Every row is treated alone, so repeated
    rows and null or repeated ids change nothing; an empty table gives an empty one. Columns of ``docs`` named like an
    output are replaced. A text of any length is searched whole; memory follows the longest text, not the batch.
    """
    others = [c for c in (docs.columns if carried is None else carried) if c not in (runs, collapsed, n_words)]
    schema = f"{runs} array<{RUN}>, {collapsed} string, {n_words} bigint"
    # the texts travel under a name of their own, as a column of any name may be among the others
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("said"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for part in sized_slices(batches, "said", SLICE_BYTES):
            texts = [t.split() for t in raw_texts(part, "said")]  # of bytes: splits at the ASCII white space
            words, starts = joined(texts)
            start, length, period = runs_of(words, max(map(len, texts), default=0))
            owner = np.searchsorted(starts, start, "right") - 1
            bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
            left = []
            for i, said in enumerate(texts):
                mine = slice(bounds[i], bounds[i + 1])
                if bounds[i] < bounds[i + 1]:
                    stay = kept_words(len(said), start[mine] - starts[i], length[mine], period[mine])
                    said = [said[k] for k in np.flatnonzero(stay).tolist()]
                left.append(b" ".join(said))
            flat = pa.StructArray.from_arrays([pa.array(x) for x in (start - starts[owner], length, period)], fields=list(run_type.value_type))
            columns = [part.column("row"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat).cast(run_type)]
            columns += [pa.array(left, pa.binary()).cast(pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row", runs, collapsed, n_words])

    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(search, f"row {row}, {schema}").select("row.*", runs, collapsed, n_words)


def looped(doc_id: Column, text: Column) -> Column:
    """The texts with some rewritten into loops: of the ids whose checksum divides by ten, words from ``a`` on repeat with
    period ``p`` (both from the checksum). Null ids and texts without words stay as they are."""
    checksum = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    g, n = F.floor(checksum / 10), F.size(words)
    return F.when((checksum % 10 == 0) & text.rlike(WORD), _looped(words, n, g)).otherwise(text)


def _looped(words: Column, n: Column, g: Column) -> Column:
    parts = F.struct(words.alias("w"), n.alias("n"), (g % n).alias("a"), g.alias("g"))
    again = F.transform(F.array(parts), lambda x: F.struct(x.w, x.n, x.a, (1 + F.floor((x.n - x.a) / (3 + x.g % 8))).alias("p")))

    def rewritten(x: Column) -> Column:
        place = lambda i: F.when(i < x.a, i).otherwise(x.a + (i - x.a) % x.p)
        return F.concat_ws(" ", F.transform(F.sequence(F.lit(0), x.n - 1), lambda i: F.get(x.w, place(i).cast("int"))))

    return F.transform(again, rewritten)[0]


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document the number of runs, the run with most repeats, and digests of all runs and of the collapsed text."""
    said = docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))
    out = with_runs(said, carried=["doc_id"])
    more = lambda best, r: best.period.isNull() | (r.length * best.period > best.length * r.period)
    first = F.lit(None).cast(RUN)
    best = F.reduce("runs", first, lambda best, r: F.when(more(best, r), r).otherwise(best))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return out.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
