"""Toxicity of a text from its nearest labelled examples.

Terms are words of letters in lower case and their first letters.  Those that
documents labelled toxic have more or less often than others beyond doubt (a
chi-squared test) are the vocabulary, and one term that every text has; their
document frequencies are counted over all documents.  An example is a labelled
document as a TF-IDF vector.  The examples make an inverted index: sorted so that similar ones lie together, cut into
blocks, with the greatest weight of every term in every block.  A text visits
the blocks by their bound, the sum of its weights times the blocks' greatest
weights, and stops at the first whose bound is under the k-th similarity found,
so its k nearest examples by cosine are exact.  They vote by 1 / distance, and
the share of toxic votes is turned into a probability by isotonic steps fitted
on other labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.sampling import draw, held_out, least_shingle, one_text
from larder.llm.tables import labels_of, map_texts, texts
from larder.llm.words import BASE, BYTE_CODES, LOWER, Words, mix, rolled, slices
from larder.session import materialise

EXAMPLES = 6_000  # at most, labelled documents in the index
CALIBRATION = 6_000  # at most, labelled documents for the steps
VOCABULARY = 4_096  # at most, for each of the classes
EVERY = np.uint64(0)  # the term of every text, the first of a vocabulary
CHI_SQUARED = 24.0  # about one chance in a million
PREFIXES = (4, 5, 6)  # bytes
NEIGHBOURS = 15
LIFT = 2.0  # times the odds of the other documents, at least, for a class among those with a term
BLOCK = 128
FIRST_BLOCKS = 6  # of the highest bounds, read before the others are judged
PRIOR_WEIGHT = 0.5  # of the share of toxic examples, as one more vote
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
THRESHOLD = 0.5


def term_rows(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and term of every word of letters, and of its beginnings."""
    letters = LETTER[words.data]
    n = len(letters)
    edge = np.zeros(n + 1, bool)
    edge[words.offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    start = np.flatnonzero(letters & (~before | edge[:n]))
    end = np.flatnonzero(letters & (~after | edge[1:])) + 1
    text = np.searchsorted(words.offsets, start, side="right") - 1
    codes = BYTE_CODES[LOWER[words.data]]
    terms, owners = [rolled(codes, start, end, BASE)], [text]
    for size in PREFIXES:
        long = end - start > size
        terms.append(mix(rolled(codes, start[long], start[long] + size, BASE) + np.uint64(size)))
        owners.append(text[long])
    return np.concatenate(owners), np.concatenate(terms)


def known_counts(words: Words, vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place in the sorted ``vocabulary`` and count of the known terms of texts."""
    if not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    text, term = term_rows(words)
    text = np.concatenate([text, np.arange(words.texts)])
    term = np.concatenate([term, np.full(words.texts, EVERY)])
    place = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    known = vocabulary[place] == term
    pair, counts = np.unique(text[known] * len(vocabulary) + place[known], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), counts


def one_of_copies(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of most groups of near copies, the least id.

    A text copied a hundred times would make all its words look telling.
    """
    schema = docs.select("doc_id").schema.add("least", "long")

    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "least": pa.array(least_shingle(words).view(np.int64))})

    first = map_texts(docs, task, schema).groupBy("least").agg(F.min("doc_id").alias("doc_id"))
    return docs.join(F.broadcast(first.select("doc_id")), "doc_id")


def choose_terms(docs: DataFrame, marked: DataFrame) -> np.ndarray:
    """The sorted vocabulary from ``marked`` (doc_id, toxic) documents of ``docs``."""
    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        text, term = term_rows(words)
        order = np.lexsort((term, text))
        text, term = text[order], term[order]
        first = np.ones(len(text), bool)
        first[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
        text, term = text[first], term[first]
        toxic = batch.column("toxic").to_numpy()[text] == 1
        # summed here, so that a task hands on each term once for a slice
        terms, place = np.unique(term, return_inverse=True)
        return pa.RecordBatch.from_pydict({
            "term": pa.array(terms.view(np.int64)),
            "n": pa.array(np.bincount(place, minlength=len(terms))),
            "bad": pa.array(np.bincount(place[toxic], minlength=len(terms)))})

    totals = marked.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).first()
    n, bad = float(totals["n"]), float(totals["bad"] or 0)
    if not 0 < bad < n:
        return np.zeros(0, np.uint64)
    counts = map_texts(docs.join(F.broadcast(marked), "doc_id"), task,
                       "term long, n long, bad long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    excess = F.col("bad") - F.col("n") * (bad / n)
    score = excess * excess / (F.col("n") * (bad / n) * (1 - bad / n) * (1 - F.col("n") / (n + 1)))
    # how the odds of a toxic document change with the term; as telling for either class
    odds = F.log((F.col("bad") + 0.5) / (F.col("n") - F.col("bad") + 0.5)) - float(
        np.log(bad / (n - bad)))
    telling = materialise(
        counts.where((F.col("n") >= 5) & (F.abs(odds) >= float(np.log(LIFT))))
        .withColumn("score", score).where(F.col("score") > CHI_SQUARED)
        .select("term", "score", (odds > 0).alias("leans")), "toxic-terms")
    best = [telling.where(F.col("leans") == leans).orderBy(F.col("score").desc(), "term")
            .limit(VOCABULARY).select("term").toPandas()["term"].to_numpy(np.int64)
            for leans in (True, False)]
    return np.unique(np.concatenate([[EVERY], *(b.view(np.uint64) for b in best)]))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many of all ``docs`` have each term, and the number of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                place = known_counts(Words(data, offsets), vocabulary)[1]
                found += np.bincount(place, minlength=len(vocabulary))
                n += len(offsets) - 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({
            "place": pa.array(np.append(some, -1)), "n": pa.array(np.append(found[some], n))})

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")).toPandas()
    found = np.zeros(len(vocabulary), np.int64)
    known = rows[rows["place"] >= 0]
    found[known["place"].to_numpy()] = known["n"].to_numpy()
    return found, int(rows.loc[rows["place"] < 0, "n"].sum())


@dataclass
class Index:
    """A block-max inverted index over example vectors."""

    vocabulary: np.ndarray  # sorted terms
    idf: np.ndarray
    doc_ids: np.ndarray  # of the examples, in index order
    toxic: np.ndarray
    share: float  # toxic among all examples
    starts: np.ndarray  # postings of term t in block b: starts[t * blocks + b] and the next
    examples: np.ndarray  # of each posting
    weights: np.ndarray
    greatest: np.ndarray  # terms x blocks
    steps: tuple[np.ndarray, np.ndarray] | None = None  # share of votes, probability

    @property
    def blocks(self) -> int:
        return self.greatest.shape[1]

    def weigh(self, text: np.ndarray, place: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """TF-IDF weights of unit vectors."""
        weight = (1 + np.log(count)) * self.idf[place]
        norm = np.sqrt(np.bincount(text, weight ** 2, minlength=n))
        return weight / norm[text]

    def similarities(self, place: np.ndarray, weight: np.ndarray, blocks: np.ndarray
                     ) -> np.ndarray:
        """Cosines with all examples, 0 outside ``blocks``."""
        cell = (place[:, None] * self.blocks + blocks).ravel()
        start = self.starts[cell]
        n = self.starts[cell + 1] - start
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.examples[at], np.repeat(np.repeat(weight, len(blocks)), n)
                           * self.weights[at], minlength=len(self.doc_ids))

    def nearest(self, place: np.ndarray, weight: np.ndarray, k: int = NEIGHBOURS
                ) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities of the ``k`` nearest that share a term, best first.

        The blocks of the highest bounds give a k-th similarity; of the others only
        those are read whose bound reaches it.  Ties go to the first in index order.
        """
        bounds = weight @ self.greatest[place]
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        similar = self.similarities(place, weight, order[:FIRST_BLOCKS])
        rest = order[FIRST_BLOCKS:]
        if len(rest):
            low = np.partition(similar, len(similar) - k)[len(similar) - k] if (
                len(similar) >= k) else 0.0
            rest = rest[bounds[rest] + 1e-9 >= low]
            if len(rest):
                similar += self.similarities(place, weight, rest)
        similar = np.round(similar, 9)
        some = np.flatnonzero(similar > 0)
        if len(some) > k:
            low = np.partition(similar[some], len(some) - k)[len(some) - k]
            some = some[similar[some] >= low]
        best = some[np.lexsort((some, -similar[some]))][:k]
        return best, similar[best]

    def vote(self, examples: np.ndarray, similar: np.ndarray) -> float:
        """Share of toxic votes, each 1 / distance; the prior share is one more voter."""
        weight = 1 / (1.05 - np.minimum(similar, 1))
        return float((weight @ self.toxic[examples] + PRIOR_WEIGHT * self.share)
                     / (weight.sum() + PRIOR_WEIGHT))

    def probability(self, votes: np.ndarray) -> np.ndarray:
        if self.steps is None:
            return votes
        return np.interp(votes, *self.steps)

    def search(self, words: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, examples and similarities of the texts with known terms."""
        text, place, count = known_counts(words, self.vocabulary)
        weight = self.weigh(text, place, count, words.texts)
        edges = np.append(np.flatnonzero(np.diff(text, prepend=-1)), len(text))
        for low, high in zip(edges[:-1], edges[1:]):
            yield int(text[low]), *self.nearest(place[low:high], weight[low:high])


def build_index(vocabulary: np.ndarray, idf: np.ndarray, doc_ids: np.ndarray, toxic: np.ndarray,
                example: np.ndarray, place: np.ndarray, count: np.ndarray) -> Index:
    """The index of examples; ``example, place, count`` are their known terms."""
    share = float(toxic.mean()) if len(toxic) else 0.0
    index = Index(vocabulary, idf, doc_ids, toxic, share, *[None] * 4)
    weight = index.weigh(example, place, count, len(doc_ids))
    heaviest = np.full(len(doc_ids), len(vocabulary))
    order = np.argsort(weight, kind="stable")
    heaviest[example[order]] = place[order]
    kept = np.unique(example)
    kept = kept[np.lexsort((doc_ids[kept], heaviest[kept]))]  # similar ones together
    number = np.zeros(len(doc_ids), np.int64)
    number[kept] = np.arange(len(kept))
    blocks = max(1, -(-len(kept) // BLOCK))
    cell = place * blocks + number[example] // BLOCK
    order = np.lexsort((number[example], cell))
    index.doc_ids, index.toxic = doc_ids[kept], toxic[kept]
    index.examples, index.weights = number[example][order], weight[order]
    index.starts = np.searchsorted(cell[order], np.arange(len(vocabulary) * blocks + 1))
    index.greatest = np.zeros(len(vocabulary) * blocks)
    np.maximum.at(index.greatest, cell, weight)
    index.greatest = index.greatest.reshape(len(vocabulary), blocks)
    return index


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the mean of ``y`` by ``x`` (pool adjacent violators)."""
    points, place = np.unique(np.round(x, 6), return_inverse=True)
    n, total = np.bincount(place).astype(float), np.bincount(place, y)
    pools: list[list[float]] = []
    for i in range(len(points)):
        pools.append([total[i], n[i], i, i])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    level = np.zeros(len(points))
    for t, m, low, high in pools:
        level[int(low):int(high) + 1] = (t + 0.5) / (m + 1)
    return points, np.maximum.accumulate(level)


def train(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES,
          calibration: int = CALIBRATION) -> Index:
    """An index of at most ``examples`` labelled documents outside the held-out fold,
    calibrated on at most ``calibration`` others.

    The driver holds the vocabulary, the known terms of the sampled documents and
    their votes; the index that goes to the tasks is bounded by ``examples`` times
    twice ``VOCABULARY`` and one.
    """
    docs = texts(docs).where("doc_id is not null")
    marked = labels_of(labels, "toxic").where(~held_out()).join(
        docs.select("doc_id").distinct(), "doc_id", "left_semi")
    drawn = draw(marked, examples + calibration, 5, "toxic")
    drawn = materialise(drawn.withColumn("half", F.pmod(F.xxhash64(F.lit(6), F.col("doc_id")),
                                                        F.lit(2))), "toxic-drawn")
    sample = materialise(one_of_copies(one_text(docs.join(F.broadcast(drawn), "doc_id"))),
                         "toxic-sample")
    first, second = sample.where("half = 0"), sample.where("half = 1")
    vocabulary = choose_terms(first.select("doc_id", "text"),
                              first.select("doc_id", "toxic").distinct())
    found, n = document_frequencies(docs, vocabulary)
    idf = np.log((1 + n) / (1 + found)) + 1

    def known(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        text, place, count = known_counts(words, vocabulary)
        every = pa.array(np.concatenate([text, np.arange(words.texts)]))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(every),
            "toxic": batch.column("toxic").take(every),
            "place": pa.array(np.concatenate([place, np.full(words.texts, -1)])),
            "count": pa.array(np.concatenate([count, np.zeros(words.texts, np.int64)]))})

    rows = map_texts(first, known, "doc_id long, toxic int, place long, count long").toPandas()
    own = rows[rows["place"] < 0].drop_duplicates("doc_id").sort_values("doc_id")
    rows = rows[rows["place"] >= 0].drop_duplicates(["doc_id", "place"])
    doc_ids = own["doc_id"].to_numpy(np.int64)
    index = build_index(vocabulary, idf, doc_ids, own["toxic"].to_numpy(float),
                        np.searchsorted(doc_ids, rows["doc_id"].to_numpy(np.int64)),
                        rows["place"].to_numpy(np.int64), rows["count"].to_numpy(np.int64))
    votes = score_texts(second, index, ["toxic"], False).select("score", "toxic").toPandas()
    if len(votes) >= 50:
        index.steps = isotonic(votes["score"].to_numpy(), votes["toxic"].to_numpy(float))
    return index


EVIDENCE = "evidence array<struct<doc_id:bigint,similarity:double,toxic:int>>"


def score_texts(docs: DataFrame, index: Index, more: list[str], evidence: bool = True) -> DataFrame:
    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        votes = np.full(words.texts, index.vote(np.zeros(0, np.int64), np.zeros(0)))
        counts = np.zeros(words.texts, np.int64)
        near, alike = [np.zeros(0, np.int64)], [np.zeros(0)]
        for i, examples, similar in index.search(words):
            votes[i] = index.vote(examples, similar)
            counts[i] = len(examples)
            near.append(examples)
            alike.append(similar)
        columns = {c: batch.column(c) for c in ["doc_id", *more]}
        columns["score"] = pa.array(index.probability(votes))
        if evidence:
            near = np.concatenate(near)
            columns["evidence"] = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)),
                pa.StructArray.from_arrays(
                    [pa.array(index.doc_ids[near]), pa.array(np.concatenate(alike)),
                     pa.array(index.toxic[near].astype(np.int32))],
                    ["doc_id", "similarity", "toxic"]))
        return pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, " + "".join(f"{c} int, " for c in more) + "score double"
    return map_texts(docs, task, f"{schema}, {EVIDENCE}" if evidence else schema)


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted (1 from ``THRESHOLD``) and
    evidence, the nearest examples with similarity and label, nearest first.

    ``docs``: doc_id, text; ``labels``: doc_id, toxic.  The score uses the text
    only.  The nearest of a text without a known term, empty or null ones too, are
    the examples without one.  Without labels of both
    kinds there is no vocabulary and every score is the share of toxic labels.
    Repeated rows score alike; a null id has no label and is not held out.  Of an
    empty table the result is empty.
    """
    index = train(docs, labels)
    return score_texts(texts(docs), index, []).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
