"""Word phrases that stand together more often than their parts suggest, counted in a vertically partitioned suffix tree.

Every place of a text begins a suffix, cut off after ``DEPTH`` words or at the end of its piece. The tree of all these
suffixes has the count of each phrase: the leaves below its node. It is never built as a whole:

1. *Prefixes of one word* are counted (``vocabulary``), and of two words (``pairs``). They are the top of the tree. Below
   a prefix that is rarer than ``least`` no phrase can be frequent, so those subtrees are cut off there.
2. *Vertical partitioning*: a prefix with more suffixes than the memory budget is extended by a word, and again up to the
   whole suffix, until it fits (``Budget``). Groups of prefixes go to tasks; the suffixes are sorted there by Spark.
3. *Subtrees*: each task walks over its sorted suffixes, which are the leaves in order, and closes a node with its leaf
   total when the words on its path change. It holds the open path only.

Words are named by 64-bit hashes of language and word. The vocabulary shows if two of them share a name; then another
seed is taken. What tasks know about frequent prefixes are bit sets of limited size: an error there lets a rare suffix
through to the count and never loses one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vektorloom.llm.common import raw_texts, settled, sized_slices
from vektorloom.llm.words import mixed

DEPTH = 4
LEAST = 30
#: A phrase is dropped if a longer one holds it in at least so many of a hundred places.
COVERED = 80
TOP = 2000

#: Bytes of text that are counted together before rows leave a task; a longer text is counted alone.
SLICE_BYTES = 8 << 20
#: A prefix with more suffixes than ``SUBTREE``, or than one in ``SHARES`` of all, is extended; but at most
#: ``MOST_EXTENDED`` are, which bounds what tasks must know.
SUBTREE, SHARES = 1_000_000, 1_000
MOST_EXTENDED = 100_000
#: Bits for each frequent prefix in a filter, and bits of the largest filter (8 MB).
FILTER_BITS, LARGEST_FILTER = 16, 1 << 26
#: Words that a task remembers.
MOST_WORDS = 250_000

#: Ends of pieces (fixed values).
STOPS = b".,;:!?\n\v\f\r"
_CUT = bytes.maketrans(STOPS, b"\xff" * len(STOPS))  # a byte that UTF-8 does not have
BREAK = 0


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case (A-Z), with ``\\xff`` between pieces."""
    return text.lower().translate(_CUT).replace(b"\xff", b" \xff ").split()


def name_of(lang: bytes, word: bytes, seed: int) -> int:
    """A signed 64-bit name that is not ``BREAK``."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(lang + b"\0" + word, seed)
    return (h - (1 << 64) if h >> 63 else h) or 1


class Names:
    """Words of all languages as numbers in order of first use, and their names."""

    def __init__(self, seed: int) -> None:
        self.seed, self.names, self.of = seed, [BREAK], {}

    def language(self, lang: bytes) -> dict[bytes, int]:
        if lang not in self.of:
            self.of[lang] = Numbers(lang, self)
        return self.of[lang]


class Numbers(dict):
    """The words of one language; 0 stands between pieces."""

    def __init__(self, lang: bytes, names: Names) -> None:
        super().__init__({b"\xff": 0})
        self.lang, self.all = lang, names

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.all.names)
        self.all.names.append(name_of(self.lang, word, self.all.seed))
        return n


def coded(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices of the corpus as numbers of words (0 between pieces and texts, ``DEPTH`` times at the end), and the names
    that the numbers stand for in this slice."""
    names = Names(seed)
    for part in sized_slices(batches, "text", SLICE_BYTES):
        if len(names.names) > MOST_WORDS:
            names = Names(seed)
        out = []
        for lang, text in zip(raw_texts(part, "lang"), raw_texts(part, "text"), strict=True):
            said = tokens(text)
            number = names.language(lang).__getitem__
            out += [np.fromiter(map(number, said), np.int32, len(said)), np.zeros(1, np.int32)]
        yield np.concatenate([*out, np.zeros(DEPTH, np.int32)]), np.array(names.names, np.int64)


def counted_words(texts: DataFrame, seed: int) -> DataFrame:
    """``lang, word, name, n`` for each word; the top of the tree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized_slices(batches, "text", SLICE_BYTES):
            seen: dict[bytes, Counter] = {}
            for lang, text in zip(raw_texts(part, "lang"), raw_texts(part, "text"), strict=True):
                seen.setdefault(lang, Counter()).update(tokens(text))
            for lang, words in seen.items():
                words.pop(b"\xff", None)
                said = pa.array(list(words), pa.binary()).cast(pa.string())
                names = pa.array([name_of(lang, w, seed) for w in words], pa.int64())
                langs = pa.array([lang.decode()] * len(words), pa.string())
                yield pa.RecordBatch.from_arrays([langs, said, names, pa.array(words.values(), pa.int64())], names=["lang", "word", "name", "n"])

    rows = texts.mapInArrow(count, "lang string, word string, name bigint, n bigint")
    return rows.groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """All words with their counts and names, and the seed with which no two words share a name."""
    seed = 0
    while True:
        words = settled(counted_words(texts, seed), "vocabulary")
        if words.groupBy("name").count().where("count > 1").isEmpty():
            return words, seed
        seed += 1


def bits_of(frequent: DataFrame, name: Column) -> np.ndarray:
    """A bit set in which each of the names has its bit; its size follows their number up to ``LARGEST_FILTER``."""
    size = 1 << 10
    wanted = frequent.count() * FILTER_BITS
    while size < min(wanted, LARGEST_FILTER):
        size *= 2
    place = name.bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    rows = frequent.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    found = rows.toArrow()  # at most LARGEST_FILTER / 64 rows
    out = np.zeros(size >> 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out


def has_bit(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names & np.int64(len(bits) * 64 - 1)
    return (bits[place >> 6] >> (place & 63)) & 1 == 1


def pair_name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for two names, for filters and partitions only: two pairs may share it."""
    return mixed(a.view(np.uint64) * np.uint64(3) + mixed(b.view(np.uint64))).view(np.int64)


def counted_pairs(texts: DataFrame, seed: int, words: np.ndarray) -> DataFrame:
    """``a, b, n`` for two frequent words in succession."""
    known = texts.sparkSession.sparkContext.broadcast(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for said, names in coded(batches, seed):
            good = (has_bit(known.value, names) & (names != BREAK))[said]
            at = np.flatnonzero(good[:-1] & good[1:])
            keys, n = np.unique(said[at].astype(np.int64) * len(names) + said[at + 1], return_counts=True)
            columns = [names[keys // len(names)], names[keys % len(names)], n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "n"])

    return texts.mapInArrow(count, "a bigint, b bigint, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Budget:
    """Prefixes with more suffixes than a subtree may have: names of words, and of pairs (``pair_name``)."""

    words: np.ndarray
    pairs: np.ndarray

    def subtree(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """A number for the prefix that a suffix belongs to."""
        two = pair_name(a, b)
        out = np.where(np.isin(a, self.words), two, mixed(a.view(np.uint64)).view(np.int64))
        return np.where(np.isin(two, self.pairs), pair_name(two, pair_name(c, d)), out)


def budget(words: DataFrame, pairs: DataFrame) -> Budget:
    total = words.agg(F.sum("n")).first()[0] or 0
    most = max(min(SUBTREE, total // SHARES), total // MOST_EXTENDED)  # so there are at most MOST_EXTENDED of either
    hot_words = words.where(F.col("n") > most).select("name").toArrow()["name"].to_numpy()
    hot = pairs.where(F.col("n") > most).select("a", "b").toArrow()
    return Budget(hot_words, pair_name(hot["a"].to_numpy().copy(), hot["b"].to_numpy().copy()))


def suffixes(texts: DataFrame, seed: int, pairs: np.ndarray, prefixes: Budget) -> DataFrame:
    """``subtree, a, b, c, d, n``: suffixes of three or four words (then ``d`` is not ``BREAK``) whose pairs may be
    frequent, each once per slice with its number."""
    known = texts.sparkSession.sparkContext.broadcast((pairs, prefixes))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, of = known.value
        for said, names in coded(batches, seed):
            first, second = said[:-1], said[1:]
            two = np.append((first != 0) & (second != 0), False)
            at = np.flatnonzero(two)
            two[at] = has_bit(bits, pair_name(names[first[at]], names[second[at]]))
            at = np.flatnonzero(two[:-1] & two[1:])  # the slice ends with breaks
            fourth = np.where(two[at + 2], said[at + 3], 0)
            heads, head = np.unique(said[at].astype(np.int64) * len(names) + said[at + 1], return_inverse=True)
            tails, tail = np.unique(said[at + 2].astype(np.int64) * len(names) + fourth, return_inverse=True)
            keys, n = np.unique(head * max(1, len(tails)) + tail, return_counts=True)
            heads, tails = heads[keys // max(1, len(tails))], tails[keys % max(1, len(tails))]
            path = [names[x] for x in (heads // len(names), heads % len(names), tails // len(names), tails % len(names))]
            columns = [of.subtree(*path), *path, n]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["subtree", "a", "b", "c", "d", "n"])

    return texts.mapInArrow(cut, "subtree bigint, a bigint, b bigint, c bigint, d bigint, n bigint")


class Level:
    """The nodes of one depth in a walk over leaves in sorted order; only the last node stays open between blocks."""

    def __init__(self, depth: int) -> None:
        self.depth, self.path, self.total = depth, np.empty((0, depth), np.int64), np.empty(0, np.int64)

    def passed(self, leaves: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nodes that close before the end of this block of leaves (rows of words, numbers), with their totals."""
        paths, n = np.concatenate([self.path, leaves[:, : self.depth]]), np.concatenate([self.total, n])
        begins = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1))) if len(paths) else []
        totals = np.add.reduceat(n, begins) if len(paths) else n
        paths = paths[begins] if len(paths) else paths
        self.path, self.total = paths[-1:], totals[-1:]
        return paths[:-1], totals[:-1]

    def closed(self) -> tuple[np.ndarray, np.ndarray]:
        return self.path, self.total


def grown(leaves: DataFrame, prefixes: Budget, least: int) -> DataFrame:
    """``a, b, c, d, n`` of the frequent nodes of three (``d`` is ``BREAK``) and four words, one subtree after another."""
    known = leaves.sparkSession.sparkContext.broadcast(prefixes)
    order = ["subtree", "a", "b", "c", "d"]

    def frequent(paths: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Frequent nodes as rows of four words and a number."""
        words = np.column_stack([paths[:, 1:], np.full((len(paths), 5 - paths.shape[1]), BREAK, np.int64)])
        if paths.shape[1] == 4:  # the places of a node of three words may lie in several subtrees
            wanted = (n >= least) | np.isin(pair_name(words[:, 0].copy(), words[:, 1].copy()), known.value.pairs)
        else:
            wanted = (n >= least) & (words[:, 3] != BREAK)
        return np.column_stack([words, n])[wanted]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        three, four = Level(4), Level(5)  # the subtree comes first
        names = ["a", "b", "c", "d", "n"]
        rows = lambda *found: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in np.concatenate(found).T], names=names)
        for batch in batches:
            leaves, n = np.column_stack([batch.column(c).to_numpy() for c in order]), batch.column("n").to_numpy()
            yield rows(frequent(*three.passed(leaves, n)), frequent(*four.passed(leaves, n)))
        yield rows(frequent(*three.closed()), frequent(*four.closed()))

    sorted_leaves = leaves.repartition("subtree").sortWithinPartitions(*order)
    nodes = sorted_leaves.mapInArrow(walk, "a bigint, b bigint, c bigint, d bigint, n bigint")
    return nodes.groupBy("a", "b", "c", "d").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def frequent_phrases(texts: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """``path, f`` (names of the words, occurrences) of all phrases of up to ``DEPTH`` words that occur ``least`` times,
    and the vocabulary. ``texts`` has ``lang`` and ``text``, both strings; ``lang`` without nulls."""
    words, seed = vocabulary(texts)
    often = F.col("n") >= least
    frequent = words.where(often)
    pairs = settled(counted_pairs(texts, seed, bits_of(frequent, F.col("name"))).where(often), "pairs")
    prefixes = budget(words, pairs)
    path = lambda *c: F.array(*c).alias("path")
    two = _pair_bits(pairs)
    nodes = settled(grown(suffixes(texts, seed, two, prefixes), prefixes, least), "nodes")
    out = frequent.select(path("name"), F.col("n").alias("f")).union(pairs.select(path("a", "b"), "n"))
    out = out.union(nodes.where(F.col("d") == BREAK).select(path("a", "b", "c"), "n"))
    return out.union(nodes.where(F.col("d") != BREAK).select(path("a", "b", "c", "d"), "n")), words


def _pair_bits(pairs: DataFrame) -> np.ndarray:
    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy().copy() for c in ("a", "b"))
            yield pa.RecordBatch.from_arrays([pa.array(pair_name(a, b), pa.int64())], names=["name"])

    return bits_of(pairs.select("a", "b").mapInArrow(name, "name bigint"), F.col("name"))


def _part(path: Column, start: int | Column, size: int | Column) -> Column:
    return F.slice(path, start, size)


def scored(phrases: DataFrame) -> DataFrame:
    """``path, a, l, r, score``: phrases of two words and more with the weakest of their cuts.

    A cut after ``k`` words is worth ``floor(2000000 * a / (l + r))`` with the occurrences of the phrase and of its two
    parts; the lowest counts, of equals the one with the least ``k``. Both parts are as frequent as the phrase at least,
    so they are among the phrases. Whole numbers of up to 38 digits are used.
    """
    size = F.size("path")
    cuts = phrases.where(size > 1).select("path", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"first": _part(F.col("path"), F.lit(1), F.col("k")), "rest": _part(F.col("path"), F.col("k") + 1, F.size("path") - F.col("k"))})
    cuts = cuts.join(phrases.select(F.col("path").alias("first"), F.col("f").alias("l")), "first")
    cuts = cuts.join(phrases.select(F.col("path").alias("rest"), F.col("f").alias("r")), "rest")
    worth = F.expr("(cast(a as decimal(38, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    least = F.min(F.struct(worth.cast("bigint").alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("path", "a").agg(least).select("path", "a", "cut.l", "cut.r", "cut.score")


def uncovered(candidates: DataFrame, phrases: DataFrame, covered: int = COVERED) -> DataFrame:
    """The candidates without those that a longer phrase holds in ``covered`` of a hundred places or more."""
    parts = [(size, start) for size in range(2, DEPTH) for start in range(1, DEPTH - size + 2)]
    inner = F.filter(F.array(*[F.when(F.size("path") > size, _part(F.col("path"), start, size)) for size, start in parts]), lambda p: p.isNotNull())
    longer = phrases.where(F.size("path") > 2).select(F.explode(inner).alias("part"), "f", F.size("path").alias("whole"))
    # a part that begins too late in a phrase of three words is cut short
    longer = longer.where((F.size("part") > 1) & (F.size("part") < F.col("whole"))).groupBy(F.col("part").alias("path")).agg(F.max("f").alias("within"))
    held = F.expr(f"cast(100 as decimal(38, 0)) * within >= cast({covered} as decimal(38, 0)) * a")
    return candidates.join(longer, "path", "left").where(F.col("within").isNull() | ~held).drop("within")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language.

    A null language is ``und``, a null text is empty; texts without words count nothing, repeated rows count repeatedly,
    other columns are not read. Ties in score and occurrences go by the bytes of the phrase. A table without a frequent
    phrase, or without rows, gives an empty one.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text"))
    phrases, words = frequent_phrases(texts, least)
    best = settled(uncovered(scored(phrases), phrases, covered), "phrases")
    of_lang = best.withColumn("name", F.col("path")[0]).join(words.select("name", "lang"), "name").drop("name")
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    first = of_lang.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= top).drop("rank")
    each = first.select("*", F.posexplode("path").alias("place", "name")).join(words.select("name", "word"), "name")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x.word), " ")
    named = each.groupBy("lang", "path", "a", "l", "r", "score").agg(said.alias("phrase"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = named.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
