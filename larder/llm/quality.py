"""Quality classifier from trusted positives and unlabelled text.

No text is taken for bad because someone said so: the fit sees documents that
are labelled good, and others without their labels.  The share of good documents
among the others, the class prior, comes from a first classifier of good against
other: the least ratio, over its thresholds, of the shares of both above it.
Then a logistic model minimises the non-negative unbiased risk

    prior * R(good, as good) + max(0, R(other, as bad) - prior * R(good, as bad))

over counts of a text's form: capitals, signs, repeated words and lines, and the
like, each cut into bins.  R uses the sigmoid loss, which is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.rules import SHOUT, SYMBOLS, UPPER, line_counts, repeated_words
from larder.llm.sampling import draw, held_out, one_text
from larder.llm.tables import labels_of, map_texts, texts
from larder.llm.words import SPACE, Words, per_text, per_text_bytes, slices
from larder.session import materialise

GOOD_ROWS = 6_000  # at most, of labelled good documents in the fit
OTHER_ROWS = 12_000  # at most, of documents without their labels
# Junk lies at the ends of a feature, so the bins are finer there.
LEVELS = (.002, .005, .01, .02, .04, .07, .1, .2, .35, .5, .65, .8, .9, .93, .96, .98, .99, .995,
          .998)
STEPS = 1_500
RATE = 0.1
DECAY = 1e-5
THRESHOLD = 0.3
DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
STOPS = np.isin(np.arange(256), list(b".,;:?"))
PIPE = np.arange(256) == ord("|")


def features(words: Words) -> np.ndarray:
    """One row of numbers for each text."""
    n = np.maximum(words.counts, 1)
    ink = ~SPACE[words.data]
    chars = np.maximum(per_text_bytes(ink, words), 1)
    share = lambda table: per_text_bytes(table[words.data], words)
    lines, repeated = line_counts(words)
    hashes = words.hashes(lower=True)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    return np.stack([
        np.log1p(words.counts), share(SYMBOLS) / n, share(SHOUT) / n, share(UPPER) / chars,
        share(PIPE) / n, share(DIGIT) / chars, share(STOPS) / n, repeated / np.maximum(lines, 1),
        repeated_words(words) / n, per_text(same, words) / n, chars / n, lines / n,
    ], axis=1)


NAMES = [f"f{i}" for i in range(12)]


def feature_rows(docs: DataFrame) -> DataFrame:
    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {
            name: pa.array(column) for name, column in zip(NAMES, features(words).T)})

    return map_texts(docs, task, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the bins of every feature."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    bias: float
    prior: float

    def cells(self, rows: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, rows[:, i], side="left") for i, e in enumerate(self.edges)]

    def margin(self, rows: np.ndarray) -> np.ndarray:
        return self.bias + sum(w[c] for w, c in zip(self.weights, self.cells(rows)))

    def score(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(rows))


def one_hot(model: Model, rows: np.ndarray) -> np.ndarray:
    cells = model.cells(rows)
    blocks = [np.eye(len(e) + 1)[c] for e, c in zip(model.edges, cells)]
    return np.concatenate([*blocks, np.ones((len(rows), 1))], axis=1)


def descend(x_good: np.ndarray, x_other: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights by Adam steps over all rows; without a prior, good against other."""
    w = np.zeros(x_good.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        good, other = sigmoid(x_good @ w), sigmoid(x_other @ w)
        if prior is None:  # logistic loss
            slope = x_good.T @ (good - 1) / len(good) + x_other.T @ other / len(other)
        else:  # sigmoid loss: what is no longer in doubt weighs no more
            lean_good, lean_other = good * (1 - good), other * (1 - other)
            as_bad = (x_other.T @ lean_other / len(other)
                      - prior * (x_good.T @ lean_good) / len(good))
            as_good = -prior * (x_good.T @ lean_good) / len(good)
            slope = as_good + as_bad if other.mean() >= prior * good.mean() else -as_bad
        slope = slope + DECAY * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope ** 2
        w = w - RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def estimate_prior(good: np.ndarray, other: np.ndarray) -> float:
    """Share of good rows among ``other`` from scores: the least ratio of upper tails.

    Each ratio is raised by its standard error, as the least of many is too low.
    """
    levels = np.quantile(good, np.linspace(0, 0.9, 181))
    above_good = 1 - np.searchsorted(np.sort(good), levels) / len(good)
    above_other = 1 - np.searchsorted(np.sort(other), levels) / len(other)
    ratio = above_other / above_good
    error = ratio * np.sqrt((1 - above_good) / (above_good * len(good))
                            + (1 - above_other) / (np.maximum(above_other, 1e-9) * len(other)))
    return float(np.clip((ratio + error).min(), 0.05, 0.99))


def fit(good: np.ndarray, other: np.ndarray) -> Model:
    """A model from feature rows of good and of other documents."""
    both = np.concatenate([good, other])
    edges = [np.unique(np.concatenate([np.quantile(other[:, i], LEVELS), [both[:, i].min()]]))
             for i in range(both.shape[1])]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], 0.0, 0.5)
    x_good, x_other = one_hot(model, good), one_hot(model, other)
    half = descend(x_good[::2], x_other[::2], None)
    prior = estimate_prior(x_good[1::2] @ half, x_other[1::2] @ half)
    w = descend(x_good, x_other, prior)
    cuts = np.cumsum([0] + [len(e) + 1 for e in edges])
    return Model(edges, [w[a:b] for a, b in zip(cuts[:-1], cuts[1:])], float(w[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, good_rows: int = GOOD_ROWS,
          other_rows: int = OTHER_ROWS) -> Model | None:
    """Fit on at most ``good_rows`` documents labelled good outside the held-out fold and
    ``other_rows`` of all; the driver gets only their features."""
    docs = texts(docs)
    good = draw(labels_of(labels, "quality").where((F.col("quality") == 1) & ~held_out()),
                good_rows, 1).withColumn("good", F.lit(True))
    other = draw(docs.where("doc_id is not null"), other_rows, 2).distinct().withColumn(
        "good", F.lit(False))
    drawn = materialise(good.unionByName(other), "quality-drawn")
    ids = drawn.select("doc_id").distinct()  # good_rows + other_rows at most
    rows = materialise(feature_rows(one_text(docs.join(F.broadcast(ids), "doc_id"))),
                       "quality-rows")
    found = rows.join(F.broadcast(drawn), "doc_id").orderBy("doc_id", *NAMES).toPandas()
    parts = [found[found["good"] == is_good][NAMES].to_numpy(float) for is_good in (True, False)]
    return fit(*parts) if all(len(p) >= 20 for p in parts) else None


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row of ``docs``; without a model every score is 0.5.

    Texts without a word, null ones included, score 0.
    """
    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        score = model.score(features(words)) if model else np.full(words.texts, 0.5)
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "score": pa.array(np.where(words.counts > 0, score, 0.0))})

    return map_texts(texts(docs), task, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train and score: doc_id, held_out, score and predicted (1 from ``THRESHOLD``).

    ``docs``: doc_id, text; ``labels``: doc_id, quality.  The score uses the text
    only.  Repeated rows score alike; a null id has no label and is not held out.
    With under 20 good labels or documents there is no model (see
    ``score_quality``); of an empty table the result is empty.
    """
    return score_quality(docs, train(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns."""
    model = train(docs, labels)
    columns = docs.columns

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                score = model.score(features(words)) if model else np.full(words.texts, 0.5)
                keep = (words.counts > 0) & (score >= THRESHOLD)
                yield batch.slice(low, high - low).filter(pa.array(keep))

    return docs.select(*columns).mapInArrow(run, docs.schema)
