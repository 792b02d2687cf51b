"""Quality by weak supervision: rules vote good or bad or abstain, and what they agree on decides.

1. ``measured`` counts what the rules look at, text by text, once.
2. Each ``Rule`` says bad, good or nothing. No rule decides alone.
3. ``fitted`` estimates, without labels, the share of bad texts and for each rule how often it says bad about bad and
   about good texts, by expectation-maximisation. All texts count: Spark sums them by pattern of votes, and there are at
   most 3 ** (number of rules) patterns, however many texts there are.
4. ``judged`` gives every text its posterior probability of being good. It replaces a filter that all rules must pass:
   one doubtful vote against many that are reliable does not drop a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektorloom.llm.common import raw_texts, settled, sized_slices
from vektorloom.llm.factors import joined, repeated_factors

#: Bytes of text that are measured together; a longer text is measured alone.
SLICE_BYTES = 8 << 20

#: Words of the windows that count as repeated (a power of two).
WINDOW = 8

WHITE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"

#: The contract's counts, then what else the rules look at.
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COUNTS = [*BASE, "n_lines", "n_letters", "n_capitals", "n_shouted", "n_wordless", "n_odd_words", "n_stutters"]


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are conditions on the counts; a text of which neither holds gets no vote."""

    name: str
    bad: Column
    good: Column


def share(name: str, part: Column, whole: Column, bad: float, good: float) -> Rule:
    """Bad above the first share, good up to the second."""
    return Rule(name, part > bad * whole, (part <= good * whole) & (whole > 0))


def rules() -> list[Rule]:
    n, c = F.col("n_words"), F.col
    length = F.col("word_chars") / F.nullif(n, F.lit(0))
    return [
        share("symbols", c("n_symbols"), n, 0.1, 0.01),
        share("odd words", c("n_odd_words"), n, 0.4, 0.15),
        share("odd characters", c("word_chars") - c("n_letters"), c("word_chars"), 0.2, 0.12),
        share("repeated windows", c("n_repeat_words"), n, 0.3, 0.05),
        share("repeated lines", c("n_dup_lines"), c("n_lines"), 0.3, 0.05),
        share("capitals", c("n_capitals"), c("n_letters"), 0.3, 0.1),
        share("shouting", c("n_shouted"), n, 0.2, 0.02),
        share("no words", c("n_wordless"), n, 0.2, 0.05),
        share("stutter", c("n_stutters"), n, 0.1, 0.02),
        Rule("word length", (length < 2.5) | (length > 12), length.between(3, 10)),
    ]


def _byte_classes() -> np.ndarray:
    kinds = np.zeros((5, 256), bool)
    white, first, symbol, letter, capital = kinds
    white[list(WHITE)] = True
    first[:] = (np.arange(256) & 0xC0) != 0x80
    symbol[list(SYMBOLS)] = True
    capital[ord("A") : ord("Z") + 1] = True
    letter[ord("a") : ord("z") + 1] = True
    letter |= capital
    letter[0xC3:] = True  # the first byte of a letter beyond ASCII; signs of the Latin-1 block begin with 0xC2
    return kinds


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    white, first, symbol, letter, capital = _byte_classes()
    said = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)  # so that a word ends with its text
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths + 1) - lengths - 1
    bounds = np.append(starts, len(said))

    def summed(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[at])

    gap = white[said]
    begins = np.flatnonzero(~gap & np.append(True, gap[:-1]))
    ends = np.flatnonzero(~gap & np.append(gap[1:], True))
    word_bounds = np.searchsorted(begins, bounds)
    letters, points = (np.append(0, np.cumsum(flags[said], dtype=np.int64)) for flags in (letter, first))
    letters_in, points_in = letters[ends + 1] - letters[begins], points[ends + 1] - points[begins]
    split = [t.split() for t in texts]  # of bytes: splits at the ASCII white space
    words, word_starts = joined(split)
    out = {
        "n_words": np.diff(word_bounds),
        "word_chars": summed(first[said] & ~gap, bounds),
        "n_symbols": summed(symbol[said], bounds),
        "n_letters": np.diff(letters[bounds]),
        "n_capitals": summed(capital[said], bounds),
        "n_shouted": summed(said[ends] == ord("!"), word_bounds),
        "n_wordless": summed(letters_in == 0, word_bounds),
        "n_odd_words": summed((letters_in == 0) | (points_in > letters_in + 1), word_bounds),
        "n_stutters": summed(np.append(False, (words[1:] == words[:-1]) & (words[1:] >= 0)), np.append(word_starts, len(words))),
    }
    covered = np.zeros(len(words) + 1, np.int64)
    for length, places, _ in repeated_factors(words, WINDOW):
        if length == WINDOW:
            covered[places] += 1  # a place starts one window
            np.add.at(covered, places + WINDOW, -1)
    out["n_repeat_words"] = summed(np.cumsum(covered[:-1]) > 0, np.append(word_starts, len(words)))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    out["n_lines"] = np.array([len(x) for x in lines], np.int64)
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    return out


def measured(docs: DataFrame, text: str = "text", carried: list[str] | None = None) -> DataFrame:
    """The columns ``carried`` (default: all but the text) and the counts, which replace columns of the same names."""
    others = [c for c in (docs.columns if carried is None else carried) if c not in COUNTS and (c != text or carried)]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("said"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sized_slices(batches, "said", SLICE_BYTES):
            counts = counts_of(raw_texts(part, "said"))
            yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(counts[c], pa.int64()) for c in COUNTS]], names=["row", *COUNTS])

    row = packed.schema["row"].dataType.simpleString()
    schema = ", ".join([f"row {row}", *[f"{c} bigint" for c in COUNTS]])
    return packed.mapInArrow(measure, schema).select("row.*", *COUNTS)


def votes(of: list[Rule]) -> Column:
    """One character per rule: ``b`` bad, ``g`` good, ``-`` no vote."""
    return F.concat(*[F.when(r.bad, "b").when(r.good, "g").otherwise("-") for r in of])


@dataclass(frozen=True)
class Accuracies:
    """Share of bad texts, and the chance that a rule which votes says bad about a bad and about a good text."""

    bad: float
    of_bad: tuple[float, ...]
    of_good: tuple[float, ...]

    def weights(self) -> list[dict[str, float]]:
        """Log odds for good that each vote of each rule adds."""
        pairs = zip(self.of_bad, self.of_good, strict=True)
        return [{"b": float(np.log(g / b)), "g": float(np.log((1 - g) / (1 - b))), "-": 0.0} for b, g in pairs]

    def good(self, pattern: Column) -> Column:
        """Posterior probability that a text with these votes is good."""
        odds = F.lit(float(np.log((1 - self.bad) / self.bad)))
        for i, weight in enumerate(self.weights()):
            vote = F.substring(pattern, i + 1, 1)
            odds = odds + F.when(vote == "b", weight["b"]).when(vote == "g", weight["g"]).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimated(patterns: dict[str, int], rounds: int = 200, close: float = 1e-9) -> Accuracies:
    """Expectation-maximisation over patterns of votes and how many texts have them.

    It starts from a belief that a text with any bad vote is probably bad. The chances get a few imagined votes (a rule is
    mostly right about good texts and finds half of the bad ones), so that a rule which never speaks stays defined, and a
    rule never counts as worse than chance: its bad vote cannot make a text better.
    """
    if not patterns:
        return Accuracies(0.5, (), ())
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    bad = np.array([[v == "b" for v in k] for k in keys], float)
    voted = np.array([[v != "-" for v in k] for k in keys], float)
    belief = np.where(bad.any(axis=1), 0.75, 0.05)
    prior, of_bad, of_good = 0.0, np.zeros(bad.shape[1]), np.zeros(bad.shape[1])
    for _ in range(rounds):
        before = np.concatenate(([prior], of_bad, of_good))
        prior = ((n * belief).sum() + 1) / (n.sum() + 2)
        of_bad = ((n * belief) @ bad + 2) / ((n * belief) @ voted + 4)
        of_good = ((n * (1 - belief)) @ bad + 0.2) / ((n * (1 - belief)) @ voted + 4)
        of_bad = np.maximum(of_bad, of_good)
        odds = np.log(prior / (1 - prior)) + bad @ np.log(of_bad / of_good) + (voted - bad) @ np.log((1 - of_bad) / (1 - of_good))
        belief = 1 / (1 + np.exp(-odds))
        if np.abs(np.concatenate(([prior], of_bad, of_good)) - before).max() < close:
            break
    return Accuracies(float(prior), tuple(of_bad.tolist()), tuple(of_good.tolist()))


def fitted(counts: DataFrame, of: list[Rule]) -> Accuracies:
    """The accuracies from all texts with a word."""
    patterns = counts.where("n_words > 0").groupBy(votes(of).alias("pattern")).count()
    found = {r["pattern"]: r["count"] for r in patterns.collect()}  # at most 3 ** len(of) rows
    none = Accuracies(0.5, (0.5,) * len(of), (0.5,) * len(of))
    return estimated(found) if found else none


def judged(docs: DataFrame, text: str = "text", carried: list[str] | None = None, of: Callable[[], list[Rule]] = rules) -> DataFrame:
    """The columns ``carried`` (default: all but the text), the counts, ``votes`` and ``good``, the posterior probability.

    Null and empty texts count zero of everything, get no votes and so the prior share of good texts. Every row counts
    for itself: repeated rows count repeatedly, null and repeated ids do not matter. An empty table gives an empty one.
    Columns named like an output are replaced. The counts are written once to the shared folder and read twice.
    """
    drop = [c for c in (docs.columns if carried is None else carried) if c not in ("votes", "good")]
    counts = settled(measured(docs, text, [c for c in drop if carried is not None or c != text]), "quality")
    return counts.withColumn("votes", votes(of())).withColumn("good", fitted(counts, of()).good(F.col("votes")))


def kept(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The contract's digest: base counts, whether the two fixed base rules fail, and whether the text is kept."""
    out = judged(docs, carried=["doc_id"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    base = [F.col(c) for c in BASE]
    good = F.round("good", 9).alias("good")
    return out.select("doc_id", *base, failed.alias("base_failed"), (~failed & (F.col("good") >= least)).alias("kept"), "votes", good)
