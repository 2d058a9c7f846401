"""Benchmark passages in documents, by latent semantic retrieval.

Texts are TF-IDF vectors of words; the document frequencies are counted over all
documents.  A randomised SVD of the benchmark items and of the passages of all
documents, whose products of terms are summed in tasks, gives a small space for every
``PIECES_AT_ONCE`` pieces of items; what it lacks of a piece is added to it.  Only
words of the pieces have a place in it; the other words of a passage count in its
length, so that a passage is close to a piece if much of it lies in the piece's
direction.  Every passage of every document (two blocks of ``STEP`` words, one
block apart) meets every piece, a passage of an item, by cosine, and is a
candidate for the item if close enough.  Then the longest common subsequence of
words between the whole item and the text around the passage decides.  A text that has most of the item counts; one that
has less of it is taken for a paraphrase if it also has the answer, the end of
the item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.tables import map_texts, pick, texts, unused
from larder.llm.words import Words, mix, seeds, slices
from larder.session import materialise

DIMENSIONS = 1 << 16  # of the hashed words
COMMON = 0.01  # of the documents; a word in more has no weight, unless items live on it
OWN_SHARE = 0.60  # of an item's squared weight, at least on words that are not common
KEPT_SHARE = 0.80  # of it on the rarest words, which are kept for an item under OWN_SHARE
RANK = 256
EXTRA = 16  # columns of the random start beyond the rank
ROUNDS = 2
PART = 64  # terms whose sums travel together; those of all tasks meet in one group
PULL = 30.0  # of an item's passages on the space; the items must be in it
FIT_TASKS = 2  # for every core; each hands on its sums
FIT_DOCUMENTS = 2_000  # as many as all documents weigh together, beside the pull of the items
SUM_CELLS = 1 << 24  # products of two terms summed in a pass over the documents
PAIRS = 1 << 21  # held at a time in a task
STEP = 16  # words in a block; a passage is two
COSINE = 0.30
SAME = 0.75  # of an item's words, in order: the item itself
LIKE = 0.50  # a paraphrase, if the answer is there
ANSWER_SHARE = 0.60  # of the answer's words, in order
ANSWER_WORDS = 8  # at least, from the end of an item
SHORT_ITEM = 8  # words; a shorter item counts only as a whole
ITEMS_AT_ONCE = 1_024  # items in the memory of a task
PIECES_AT_ONCE = 192  # of items in one space, fewer than its rank
SPACES_AT_ONCE = 8  # in the memory of a task; those of one item stay together
LOST = 0.05  # of the length of a piece outside its space, at most


def bins(words: Words, hashes: np.ndarray | None = None) -> np.ndarray:
    hashes = words.hashes(lower=True) if hashes is None else hashes
    return (mix(hashes) % np.uint64(DIMENSIONS)).astype(np.int32)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Inverse document frequency of every dimension over all ``docs``, and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(DIMENSIONS + 1, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                pair = np.unique(words.text * DIMENSIONS + bins(words))
                found[:DIMENSIONS] += np.bincount(pair % DIMENSIONS, minlength=DIMENSIONS)
                found[DIMENSIONS] += words.texts
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"place": pa.array(some), "n": pa.array(found[some])})

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(
        F.sum("n").alias("n")).toPandas()  # DIMENSIONS + 1 rows at most
    found = np.zeros(DIMENSIONS + 1, np.int64)
    found[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return (np.log((1 + found[-1]) / (1 + found[:-1])) + 1).astype(np.float32), int(found[-1])


def passages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first and last word (exclusive) of the passages of texts.

    They begin every ``STEP`` words; the last one ends with the text.
    """
    blocks = -(-words.counts // STEP)
    n = np.maximum(blocks - 1, blocks > 0)
    text = np.repeat(np.arange(words.texts), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = words.first[text] + STEP * place
    return text, first, np.minimum(first + 2 * STEP, words.first[text + 1])


def pieces(item_texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Item number and text of the passages of items."""
    words = joined(item_texts)
    item, first, end = passages(words)
    raw = words.data.tobytes()
    return item, [raw[a:b].decode() for a, b in zip(words.start[first], words.end[end - 1])]


class Terms:
    """The dimensions that have a place in the space, and the weights of all.

    An item that many documents hold makes its own words common.  Its rarest
    words keep their weight, so that it is found all the same.
    """

    def __init__(self, idf: np.ndarray, item_texts: list[str]):
        words = joined(item_texts)
        places = bins(words)
        rare = idf >= 1 - np.log(COMMON)
        for low, high in zip(words.first[:-1], words.first[1:]):
            own = np.unique(places[low:high])
            energy = idf[own] ** 2
            if energy[rare[own]].sum() < OWN_SHARE * energy.sum():
                order = np.argsort(-energy, kind="stable")
                before = np.cumsum(energy[order]) - energy[order]
                rare[own[order[before < KEPT_SHARE * energy.sum()]]] = True
        self.idf = np.where(rare, idf, 0).astype(np.float32)
        own = np.unique(places[rare[places]])
        self.size = len(own)
        self.column = np.full(DIMENSIONS, -1, np.int32)
        self.column[own] = np.arange(len(own))
        self.weight = self.idf[own]


def joined(item_texts: list[str]) -> Words:
    raw = [t.encode() for t in item_texts]
    return Words(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))


def lengths(places: np.ndarray, first: np.ndarray, end: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF lengths of the given runs of words, each occurrence for itself."""
    sums = np.concatenate([[0], np.cumsum(idf[places].astype(np.float64) ** 2)])
    return np.sqrt(np.maximum(sums[end] - sums[first], 1e-9))


def add_products(words: Words, places: np.ndarray, terms: Terms, total: np.ndarray) -> None:
    """A^T A of the passages A of ``words`` added to ``total``, a row and column per term."""
    column = terms.column[places]
    known = np.flatnonzero(column >= 0)
    text, first, end = passages(words)
    low = np.searchsorted(known, first)
    n = np.searchsorted(known, end) - low
    some = np.flatnonzero(n)
    low, n = low[some], n[some]
    length = lengths(places, first[some], end[some], terms.idf)
    column = column[known]
    weight, flat = terms.weight[column], total.reshape(-1)
    strip = np.cumsum(n * n) // PAIRS
    for at in range(int(strip[-1]) + 1 if len(strip) else 0):
        part = slice(*np.searchsorted(strip, [at, at + 1]))
        entry = ranges(low[part], n[part])
        size = np.repeat(n[part], n[part])
        one, other = np.repeat(entry, size), ranges(np.repeat(low[part], n[part]), size)
        squared = np.repeat(length[part] ** 2, n[part] ** 2)
        np.add.at(flat, column[one].astype(np.int64) * terms.size + column[other],
                  (weight[one] * weight[other] / squared).astype(flat.dtype))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def products(docs: DataFrame, spaces: list[Terms]) -> list[np.ndarray]:
    """A^T A of the passages A of all ``docs``, for the terms of every space; every task sums
    its own.  Spaces of up to ``SUM_CELLS`` products, or the one that has more, share a
    pass over the documents.

    The driver gets the products of two terms, whose number follows the items only.
    """
    cells = np.cumsum([t.size ** 2 for t in spaces])
    passes: dict[int, list[int]] = {}
    for i, before in enumerate(cells):
        passes.setdefault(int(before - 1) // SUM_CELLS, []).append(i)
    totals = [np.zeros((t.size, t.size), np.float32) for t in spaces]
    few = docs.select("text").coalesce(
        FIT_TASKS * docs.sparkSession.sparkContext.defaultParallelism)
    for own in passes.values():
        for row in _sums(few, {i: spaces[i] for i in own}):
            part = np.frombuffer(row["rows"], np.float32).reshape(-1, spaces[row["space"]].size)
            totals[row["space"]][PART * row["part"]:][:len(part)] = part
    return totals


def _sums(docs: DataFrame, spaces: dict[int, Terms]) -> list:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {i: np.zeros((t.size, t.size), np.float32) for i, t in spaces.items()}
        for batch in batches:
            for _, _, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets)
                places = bins(words)
                for i, terms in spaces.items():
                    add_products(words, places, terms, totals[i])
        for i, total in totals.items():
            for low in range(0, len(total), PART):
                yield pa.RecordBatch.from_pydict({
                    "space": pa.array([i]), "part": pa.array([low // PART]),
                    "rows": pa.array([total[low:low + PART].tobytes()], pa.binary())})

    def add(rows: pd.DataFrame) -> pd.DataFrame:  # a part of the terms, of every task
        total = sum(np.frombuffer(r, np.float32).astype(float) for r in rows["rows"])
        return rows[["space", "part"]][:1].assign(rows=[total.astype(np.float32).tobytes()])

    schema = "space long, part long, rows binary"
    return docs.mapInArrow(run, schema).groupBy("space", "part").applyInPandas(
        add, schema).collect()


def latent_space(total: np.ndarray, terms: Terms, piece_texts: list[str], rank: int = RANK
                 ) -> np.ndarray:
    """The first ``rank`` right singular vectors, weighted; the last row is for other words.

    ``total`` has the ``products`` of the documents; those of the pieces are added.  Pieces that lose more than ``LOST`` of their length there add what is missing.
    """
    if not terms.size:
        return np.zeros((1, 1), np.float32)
    words = joined(piece_texts)
    own = np.zeros_like(total)
    add_products(words, bins(words), terms, own)
    total = total + PULL ** 2 * own
    size = min(rank + EXTRA, terms.size)
    signs = (mix(seeds(terms.size * size, 23)) >> np.uint64(63)).astype(np.float32) * 2 - 1
    basis = signs.reshape(terms.size, size)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(total @ basis)[0].astype(np.float32)
    inner = basis.T @ (total @ basis)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    best = np.argsort(-values)[:rank]
    space = basis @ vectors[:, best]
    column = terms.column[bins(words)]
    own = np.zeros((words.texts, terms.size))
    np.add.at(own, (words.text[column >= 0], column[column >= 0]), 1)
    own *= terms.weight
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    rest = own - (own @ space) @ space.T
    rest = rest[np.linalg.norm(rest, axis=1) > LOST]
    if len(rest):
        _, sizes, more = np.linalg.svd(rest, full_matrices=False)
        space = np.concatenate([space, more[sizes > LOST * LOST].T], axis=1)
    space = space * terms.weight[:, None]
    return np.concatenate([space, np.zeros((1, space.shape[1]))]).astype(np.float32)


def project(places: np.ndarray, words: Words, terms: Terms, space: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``passages`` with a word of the space, and their vectors over their full lengths."""
    text, first, end = passages(words)
    blocks = -(-words.counts // STEP)
    begin = np.repeat(words.first[:-1], blocks) + STEP * (
        np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    column = terms.column[places]
    known = np.flatnonzero(column >= 0)
    owner = np.searchsorted(begin, known, side="right") - 1
    filled, at = np.unique(owner, return_index=True)
    sums = np.zeros((len(begin) + 1, space.shape[1]), np.float32)  # the last for no block
    if len(known):
        sums[filled] = np.add.reduceat(space[column[known]], at, axis=0)
    block = np.searchsorted(begin, first)
    second = np.where(end - first > STEP, block + 1, len(begin))
    has = np.zeros(len(begin) + 1, bool)
    has[filled] = True
    some = np.flatnonzero(has[block] | has[second])
    text, first, end = text[some], first[some], end[some]
    vectors = sums[block[some]] + sums[second[some]]
    return text, first, end, vectors / lengths(
        places, first, end, terms.idf)[:, None].astype(np.float32)


def common(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, by bits of one long integer."""
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for word in text:
        match = row & masks.get(word, 0)
        if match:
            row = ((row + match) | (row - match)) & full
    return len(item) - row.bit_count()


class Items:
    """Benchmark items, ready for comparison."""

    def __init__(self, ids: list[int], item_texts: list[str]):
        words = joined(item_texts)
        hashes = words.hashes(lower=True)
        self.ids = ids
        self.words = [hashes[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:])]
        self.answers = [max(ANSWER_WORDS, len(w) // 4) for w in self.words]

    def verdict(self, item: int, text: list[int]) -> tuple[float, bool, bool]:
        """Share of the item in ``text``, whether the answer is there, and whether it is a leak."""
        own = self.words[item]
        share = common(own, text) / len(own)
        tail = own[-self.answers[item]:]
        answer = common(tail, text) >= ANSWER_SHARE * len(tail)
        least = SAME if len(own) >= SHORT_ITEM else 1.0
        return share, answer, share >= least or (share >= LIKE and answer
                                                 and len(own) >= SHORT_ITEM)


FOUND = ("doc_id long, item_id long, cosine double, share double, answer boolean, "
         "first_word long, last_word long")


class Pieces:
    """Pieces of items in a space that holds them all."""

    def __init__(self, owners: list[int], piece_texts: list[str], terms: Terms, space: np.ndarray):
        words = joined(piece_texts)
        self.owners, self.terms, self.space = owners, terms, space
        # a short item is only a part of a passage
        self.reach = np.sqrt(np.minimum(1, words.counts / STEP))
        sums = np.zeros((words.texts, space.shape[1]), np.float32)
        np.add.at(sums, words.text, space[terms.column[bins(words)]])
        self.vectors = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)


def search(docs: DataFrame, items: Items, parts: list[Pieces], cosine: float) -> DataFrame:
    """The best confirmed passage of each item in each document.

    A column ``key`` of ``docs`` goes with doc_id.
    """
    keyed = "key" in docs.columns

    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        hashes = words.hashes(lower=True)
        places = bins(words, hashes)
        close_ones: dict[tuple[int, int, int], float] = {}  # item, first and last word compared
        for part in parts:
            text, first, end, vectors = project(places, words, part.terms, part.space)
            for low in range(0, len(text), 4096):
                near = vectors[low:low + 4096] @ part.vectors.T
                for row, piece in np.argwhere(near >= cosine * part.reach).tolist():
                    p, item = low + row, part.owners[piece]
                    size = len(items.words[item])
                    key = (item, max(int(first[p]) - size, int(words.first[text[p]])),
                           min(int(end[p]) + size, int(words.first[text[p] + 1])))
                    close_ones[key] = max(close_ones.get(key, 0.0), float(near[row, piece]))
        best: dict[tuple[int, int], tuple] = {}
        for (item, begin, close), near_by in sorted(close_ones.items()):
            share, answer, leak = items.verdict(item, hashes[begin:close].tolist())
            text = int(words.text[begin])
            if leak and ((text, item) not in best or best[text, item][0] < share):
                best[text, item] = (share, near_by, answer, begin - int(words.first[text]),
                                    close - int(words.first[text]))
        keys = sorted(best)
        rows = [best[k] for k in keys]
        owners = pa.array([k[0] for k in keys], pa.int64())
        return pa.RecordBatch.from_pydict({
            **({"key": batch.column("key").take(owners)} if keyed else {}),
            "doc_id": batch.column("doc_id").take(owners),
            "item_id": pa.array([items.ids[k[1]] for k in keys], pa.int64()),
            "cosine": pa.array([r[1] for r in rows], pa.float64()),
            "share": pa.array([r[0] for r in rows], pa.float64()),
            "answer": pa.array([r[2] for r in rows], pa.bool_()),
            "first_word": pa.array([r[3] for r in rows], pa.int64()),
            "last_word": pa.array([r[4] for r in rows], pa.int64())})

    return map_texts(docs, task, "key long, " + FOUND if keyed else FOUND)


def item_parts(benchmark: DataFrame, at_once: int = ITEMS_AT_ONCE
               ) -> Iterator[tuple[list[int], list[str]]]:
    """The items with words, in parts of ``at_once``; a benchmark of any size goes in parts."""
    items = pick(benchmark, item_id="long", text="string").dropna().where(
        F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).distinct()
    last: tuple | None = None
    while True:
        rest = items if last is None else items.where(
            (F.col("item_id") > last[0]) | (F.col("item_id") == last[0]) & (F.col("text") > last[1]))
        rows = rest.orderBy("item_id", "text").limit(at_once).collect()
        if rows:
            yield [r["item_id"] for r in rows], [r["text"] for r in rows]
        if len(rows) < at_once:
            return
        last = (rows[-1]["item_id"], rows[-1]["text"])


def groups(item_texts: list[str]) -> list[tuple[int, int]]:
    """First and last item (exclusive) of runs of items with a bounded number of pieces."""
    n = np.bincount(pieces(item_texts)[0], minlength=len(item_texts))
    group = (np.cumsum(n) - n) // (PIECES_AT_ONCE * SPACES_AT_ONCE)
    edges = [*np.flatnonzero(np.diff(group, prepend=-1)).tolist(), len(item_texts)]
    return list(zip(edges[:-1], edges[1:]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Which documents hold which benchmark items.

    ``docs``: doc_id, text; ``benchmark``: item_id, text.  Returns one row per
    document and item found: doc_id, item_id, cosine, share (of the item's words,
    in order), answer (whether its end is there) and first_word and last_word of
    the text compared.  Words are in lower-case A-Z.

    Null and empty texts hold nothing; null ids and null or empty items are no
    items.  Rows that repeat an id are judged each by its text, and a null doc_id
    comes out null.  An item of under ``SHORT_ITEM`` words must be there as a
    whole.  Empty tables give an empty result.  Every document is in the fit of
    the spaces, and is searched.
    """
    return _find(texts(docs), benchmark, cosine)


def _find(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    found: list[DataFrame] = []
    idf = None
    for ids, item_texts in item_parts(benchmark):
        if idf is None:
            idf, n_docs = document_frequencies(docs)
        for low, high in groups(item_texts):
            owners, piece_texts = pieces(item_texts[low:high])
            some = [piece_texts[at:at + PIECES_AT_ONCE]
                    for at in range(0, len(owners), PIECES_AT_ONCE)]
            spaces = [Terms(idf, s) for s in some]
            share = min(1.0, FIT_DOCUMENTS / max(1, n_docs))
            parts = []
            for i, (own, terms, total) in enumerate(zip(some, spaces, products(docs, spaces))):
                at = i * PIECES_AT_ONCE
                space = latent_space(share * total, terms, own)
                parts.append(Pieces(owners[at:at + PIECES_AT_ONCE].tolist(), own, terms, space))
            found.append(search(docs, Items(ids[low:high], item_texts[low:high]), parts, cosine))
    if not found:
        return spark.createDataFrame([], "key long, " + FOUND if "key" in docs.columns else FOUND)
    return reduce(DataFrame.unionByName, found)


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns, whatever their names.

    A row is judged by its own text, so of rows with one id, or without an id, those go
    that hold an item.
    """
    own, of_id, of_text = (unused(docs, c) for c in ("_text_hash", "_leak_id", "_leak_text"))
    key = F.xxhash64(docs["text"].cast("string"))
    rows = pick(docs.select("doc_id", "text", key.alias("key")),
                key="long", doc_id="long", text="string")
    leaks = materialise(_find(rows, benchmark).select(
        F.col("doc_id").alias(of_id), F.col("key").alias(of_text)).distinct(), "leaks")
    return docs.withColumn(own, key).join(
        leaks, docs["doc_id"].eqNullSafe(F.col(of_id)) & (F.col(own) == F.col(of_text)),
        "left_anti").drop(own)
