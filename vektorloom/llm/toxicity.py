"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vektorloom.llm.common import SLICE_ROWS, keep_only, map_rows

#: Rows that the classifiers are fitted on, in expectation: confirmed toxic texts and unlabelled texts, drawn by a hash
#: of their id. Everything else (prior, scores) covers all rows.
MOST_TOXIC, MOST_UNLABELLED = 4000, 12000

#: Classifiers, features of each, and steps of gradient descent.
CLASSIFIERS, FEATURES, STEPS = 3, 4096, 250

#: Words whose features one task remembers.
MOST_WORDS = 100_000


def held_out(doc_id: Column) -> Column:
    """True for the fold whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def features_of(word: str) -> tuple[str, ...]:
    """The word without case and signs, and its beginnings."""
    plain = "".join(filter(str.isalnum, word.casefold()))
    return (f"={plain}", *(plain[:n] for n in (4, 5, 6) if len(plain) > n)) if plain else ()


class Words(dict):
    """Features of a word that the model knows."""

    def __init__(self, known=None):
        self.known = known

    def __missing__(self, word: str):
        if len(self) > MOST_WORDS:
            self.clear()
        known = self.known
        found = features_of(word)
        kept = self[word] = found if known is None else tuple(known[f] for f in found if f in known)
        return kept

    def of(self, text: str) -> set:
        return set().union(*map(self.__getitem__, set(text.split())))


@dataclass
class Model:
    """Weights of the known features per classifier, their biases, and the class prior."""

    features: list[str]
    weights: np.ndarray
    biases: np.ndarray
    prior: float

    def scores(self, rows: list[set]) -> np.ndarray:
        """Mean probability over the classifiers."""
        margins = np.array([self.weights[:, list(row)].sum(axis=1) if row else np.zeros(len(self.biases)) for row in rows])
        return sigmoid(margins.reshape(len(rows), len(self.biases)) + self.biases).mean(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Sparse:
    """Rows of feature numbers, each present or not."""

    def __init__(self, rows: list[list[int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], dtype=np.int64)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.n)

    def back(self, slopes: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, slopes[self.row], self.width)


def fit(positive: Sparse, unlabelled: Sparse, prior: float, steps: int = STEPS, rate: float = 0.1, decay: float = 1e-4):
    """Weights and bias that minimise the non-negative risk by Adam.

    With the logistic loss, the risk of calling positives negative is ``prior * mean(loss(positive, +1))``; that of
    calling negatives positive is estimated as ``mean(loss(unlabelled, -1)) - prior * mean(loss(positive, -1))``. Where
    this estimate falls below zero the model has learned the unlabelled positives by heart, and the step goes back up.
    """
    width = positive.width
    weights, bias = np.zeros(width), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z_p, z_u = positive.times(weights) + bias, unlabelled.times(weights) + bias
        negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        up_p, up_u = sigmoid(z_p) / positive.n, sigmoid(z_u) / unlabelled.n
        if negative >= 0:
            slope_p, slope_u = -prior * sigmoid(-z_p) / positive.n - prior * up_p, up_u
        else:
            slope_p, slope_u = prior * up_p, -up_u
        slope = np.append(positive.back(slope_p) + unlabelled.back(slope_u) + decay * weights, slope_p.sum() + slope_u.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def cut_at(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """The margin that best tells the classes apart, from positives and unlabelled texts only.

    ``recall**2 / share of unlabelled texts above`` is in proportion to precision times recall.
    """
    cuts = np.quantile(positive, np.linspace(0.005, 0.6, 120))
    recall = np.array([(positive >= c).mean() for c in cuts])
    above = np.array([max((unlabelled >= c).mean(), prior * r) for c, r in zip(cuts, recall)])
    best = np.argmax(recall**2 / np.maximum(above, 1e-9))
    below = unlabelled[unlabelled < cuts[best]]
    # halfway between the cut and the next text below it
    return float((cuts[best] + below.max()) / 2) if len(below) else float(cuts[best] - 1)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Classifiers from the toxic rows of ``labels`` outside the held-out fold; None if there are none.

    Labels say which texts are confirmed toxic and how common that is; labelled clean texts are not used as such. A
    document with several labels is toxic if any says so. The sampled rows travel as their known features only.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    marks = marks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return None
    prior = min(max(toxic / n, 1e-3), 0.9)
    chosen = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    confirmed = marks.where("toxic = 1").where(chosen < MOST_TOXIC / toxic).select("doc_id", F.lit(True).alias("confirmed"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    total = rows.select("doc_id").count()
    # the confirmed rows are MOST_TOXIC in expectation, so they may be sent to every task
    drawn = rows.withColumn("unlabelled", chosen < MOST_UNLABELLED / max(total, 1)).join(F.broadcast(confirmed), "doc_id", "left")
    drawn = drawn.where("unlabelled OR confirmed").select(
        F.coalesce("confirmed", F.lit(False)).alias("confirmed"), "unlabelled", F.coalesce("text", F.lit("")).alias("text")
    )

    def all_features():
        words = Words()

        def work(columns):
            return {
                "confirmed": columns["confirmed"],
                "unlabelled": columns["unlabelled"],
                "features": [sorted(words.of(t)) for t in columns["text"]],
            }

        return work

    sample = map_rows(drawn, all_features, "confirmed boolean, unlabelled boolean, features array<string>")
    p, u = F.col("confirmed").cast("long"), F.col("unlabelled").cast("long")
    n_p, n_u = sample.select(p.alias("p"), u.alias("u")).agg(F.sum("p"), F.sum("u")).first()
    if not n_p or not n_u:
        return None
    counts = sample.select(p.alias("p"), u.alias("u"), F.explode("features").alias("feature"))
    counts = counts.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    share, all_share, small = F.col("p") / n_p, F.col("u") / n_u, F.lit(1.0 / n_u)
    clean_share = F.greatest(F.lit(0.0), (all_share - prior * share) / (1 - prior))
    lift = (share + small) / (clean_share + small)
    best = counts.where(F.col("p") >= max(2, n_p // 1000)).withColumns({"lift": lift, "gain": share * F.log(lift)}).where("lift > 4")
    features = [r[0] for r in best.orderBy(F.desc("gain"), "feature").limit(FEATURES).select("feature").collect()]
    if not features:
        return Model([], np.zeros((1, 0)), np.array([np.log(prior / (1 - prior))]), prior)
    known = {f: i for i, f in enumerate(features)}

    def known_features():
        words = Words(known)

        def work(columns):
            return {
                "confirmed": columns["confirmed"],
                "unlabelled": columns["unlabelled"],
                "known": [sorted(words.of(t)) for t in columns["text"]],
            }

        return work

    fitted = map_rows(drawn, known_features, "confirmed boolean, unlabelled boolean, known array<int>").collect()
    positive = [r["known"] for r in fitted if r["confirmed"]]
    unlabelled = [r["known"] for r in fitted if r["unlabelled"]]
    positive.sort()
    unlabelled.sort()
    random = np.random.default_rng(7)
    weights, biases = [], []
    for _ in range(CLASSIFIERS):
        # two thirds are learned from, the cut is set by the rest
        parts = []
        for rows_of in (positive, unlabelled):
            order = random.permutation(len(rows_of))
            cut = max(1, len(rows_of) * 2 // 3)
            parts.append((Sparse([rows_of[i] for i in order[:cut]], len(features)), Sparse([rows_of[i] for i in order[cut:]] or rows_of, len(features))))
        (p_fit, p_rest), (u_fit, u_rest) = parts
        w, b = fit(p_fit, u_fit, prior)
        weights.append(w)
        biases.append(b - cut_at(p_rest.times(w) + b, u_rest.times(w) + b, prior))
    return Model(features, np.array(weights), np.array(biases), prior)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, held_out, score`` (0 to 1, higher: toxic likelier) and ``predicted``.

    Every whole text is scored by its words alone; null and empty texts get the score of a text without known words.
    Rows without an id count as held out. Repeated rows are scored alike, other columns are not read. Without a
    confirmed toxic text all scores are 0. An empty table gives no rows.
    """
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return with_scores(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_scores(rows: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, score`` from ``doc_id, held_out, text``."""

    def make():
        words = Words({f: i for i, f in enumerate(model.features)}) if model else None

        def work(columns):
            texts = columns["text"]
            scores = model.scores([words.of(t or "") for t in texts]) if model else np.zeros(len(texts))
            return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores.tolist()}

        return work

    return map_rows(rows, make, "doc_id long, held_out boolean, score double")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below one half; texts do not move."""
    model = train(docs, labels)
    if model is None:
        return docs
    known = {f: i for i, f in enumerate(model.features)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(None)
        words = Words(known)
        for batch in batches:
            # the words of a short slice are held at once, not those of a whole batch
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                scores = model.scores([words.of(t or "") for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)
