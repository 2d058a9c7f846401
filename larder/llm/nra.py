"""Ranked lexical search by sorted reads alone (NRA, Fagin, Lotem & Naor 2001).

One pass over the documents keeps, per document, its number of terms and the counts
of the terms that the items ask for.  From these come the corpus counts, the weights
and, per block of documents, a posting list for every term in falling order of
impact.  A task reads an item's lists of its block side by side, from their fronts,
twice as far each time.  What was read bounds every document's score from below;
the last impacts read of the lists in which it did not appear bound it from above.
A document that cannot reach the k-th lower bound is out.  Reading goes on until no
unread document can enter and both bounds of every document that is left are equal,
so that membership, ties and scores are settled without one random access.

Terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.tables import map_texts, pick, texts
from larder.llm.words import BASE, BYTE_CODES, LOWER, Words, rolled
from larder.operators.fulltext import top_k
from larder.session import materialise

TOP = 50
# Terms of items in one pass over the documents; more items take more passes.
TERMS_AT_ONCE = 1 << 20
# A block ends with the batch that brings it to so many postings or documents.
BLOCK_POSTINGS = 1 << 20
BLOCK_DOCS = 1 << 14
FIRST_READ = 64  # entries of every list; the next reads double
FLOOR_ONE_IN = 16  # of the documents give every item a lower bound of its last score
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[48:58] = TERM_BYTE[65:91] = TERM_BYTE[97:123] = True
TERM_BYTE[128:] = True


def term_runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every run of digits, letters and characters from U+0080 on."""
    ink = TERM_BYTE[words.data]
    n = len(ink)
    edge = np.zeros(n + 1, bool)
    edge[words.offsets] = True
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = ink[:-1], ink[1:]
    start = np.flatnonzero(ink & (~before | edge[:n]))
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    text = np.searchsorted(words.offsets, start, side="right") - 1
    return text, rolled(BYTE_CODES[LOWER[words.data]], start, end, BASE)


def number_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``number, item_id`` of every row of ``items``, and ``number, term``, once each."""
    numbered = materialise(pick(items, item_id="long", text="string")
                           .withColumn("number", F.monotonically_increasing_id()), "items")

    def terms(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        text, term = term_runs(words)
        return pa.RecordBatch.from_pydict({
            "number": batch.column("number").take(pa.array(text)),
            "term": pa.array(term.view(np.int64))})

    return numbered.select("number", "item_id"), materialise(
        map_texts(numbered, terms, "number long, term long").distinct(), "item-terms")


def count_terms(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """``doc_id, n, place, tf`` per document: number of all its terms, and places in the
    sorted ``known`` and counts of those that are among them."""
    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        text, term = term_runs(words)
        n = np.bincount(text, minlength=words.texts)
        place = np.minimum(np.searchsorted(known, term), max(len(known) - 1, 0))
        hit = known[place] == term if len(known) else np.zeros(len(term), bool)
        pair, tf = np.unique(text[hit] * np.int64(max(len(known), 1)) + place[hit],
                             return_counts=True)
        owner, place = np.divmod(pair, max(len(known), 1))
        starts = pa.array(np.searchsorted(owner, np.arange(words.texts + 1)).astype(np.int32))
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n": pa.array(n),
            "place": pa.ListArray.from_arrays(starts, pa.array(place.astype(np.int32))),
            "tf": pa.ListArray.from_arrays(starts, pa.array(tf.astype(np.int64)))})

    return materialise(map_texts(docs, task, "doc_id long, n long, place array<int>, "
                                             "tf array<long>"), "term-counts")


@dataclass(frozen=True)
class Request:
    """What a task needs of a part of the items."""

    numbers: np.ndarray  # of the items
    starts: np.ndarray   # places of item i: starts[i] and the next
    places: np.ndarray
    weights: np.ndarray  # of the terms, by place
    n_docs: int          # with a term
    n_terms: int         # of all documents
    floors: np.ndarray   # per item; no document under it is among the best


def sorted_reads(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, floor: int
                 ) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the best ``k``, their exact scores, and entries read.

    ``lists`` holds documents and positive gains in falling order.  All documents that
    reach the k-th best score and ``floor`` are returned, ties included.
    """
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    out = np.zeros(n_docs, bool)
    at, step, read, closed = 0, FIRST_READ, 0, False
    while True:
        frontier = np.zeros(len(lists), np.int64)
        for i, (docs, gains) in enumerate(lists):
            here, gain = docs[at:at + step], gains[at:at + step]
            read += len(here)
            if closed:
                left = ~out[here]
                here, gain = here[left], gain[left]
            lower[here] += gain
            seen[i, here] = True
            if at + step < len(docs):
                frontier[i] = gains[at + step - 1]
        at, step = at + step, 2 * step
        own = np.flatnonzero((lower > 0) & ~out)
        low = lower[own]
        high = low + frontier.sum() - frontier @ seen[:, own]
        least = max(floor, 1)
        if len(own) >= k:
            least = max(least, int(np.partition(low, len(own) - k)[len(own) - k]))
        able = high >= least
        out[own[~able]] = True
        if frontier.sum() < least:  # nothing unread can enter any more
            if not closed:
                closed = True
                out[lower == 0] = True
            if (high == low)[able].all():
                return own[able], low[able], read


def search_block(ids: pa.Array, n: np.ndarray, owner: np.ndarray, place: np.ndarray,
                 tf: np.ndarray, request: Request, k: int) -> pa.RecordBatch:
    """``number, doc_id, score`` of the best ``k`` documents of a block for every item."""
    m = 100 - 50 + (50 * n * request.n_docs) // max(request.n_terms, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[owner])
    order = np.lexsort((owner, -impact, place))
    owner, impact = owner[order], impact[order]
    starts = np.searchsorted(place[order], np.arange(len(request.weights) + 1))
    unknown = ids.is_null().to_numpy(zero_copy_only=False)
    keys = ids.fill_null(0).to_numpy()
    numbers, docs, scores = [], [], []
    for i, number in enumerate(request.numbers):
        lists = []
        for p in request.places[request.starts[i]:request.starts[i + 1]]:
            low, high = starts[p], starts[p + 1]
            weight = request.weights[p]
            if weight > 0 and high > low and impact[low] > 0:
                gains = weight * impact[low:high]
                high = low + int(np.searchsorted(-gains, 0))  # entries without gain
                lists.append((owner[low:high], gains[:high - low]))
        if not lists:
            continue
        found, score, _ = sorted_reads(lists, len(keys), k, int(request.floors[i]))
        best = np.lexsort((keys[found], unknown[found], -score))[:k]
        numbers.append(np.full(len(best), number))
        docs.append(found[best])
        scores.append(score[best])
    empty = [np.zeros(0, np.int64)]
    return pa.RecordBatch.from_pydict({
        "number": pa.array(np.concatenate(empty + numbers)),
        "doc_id": ids.take(pa.array(np.concatenate(empty + docs))),
        "score": pa.array(np.concatenate(empty + scores))})


def search_counts(counts: DataFrame, request: Request, k: int) -> DataFrame:
    """``number, doc_id, score``: the best ``k`` of every block of the rows of ``counts``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, entries = [], 0, 0

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, n, place, tf = (table.column(c).combine_chunks() for c in table.column_names)
            if isinstance(ids, pa.ChunkedArray):
                ids, n, place, tf = (c.chunk(0) for c in (ids, n, place, tf))
            sizes = np.diff(place.offsets.to_numpy())
            return search_block(ids, n.to_numpy(), np.repeat(np.arange(len(ids)), sizes),
                                place.flatten().to_numpy(), tf.flatten().to_numpy(), request, k)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            entries += len(batch.column("place").flatten())
            if rows >= BLOCK_DOCS or entries >= BLOCK_POSTINGS:
                yield block()
                held, rows, entries = [], 0, 0
        if held:
            yield block()

    return counts.select("doc_id", "n", "place", "tf").mapInArrow(
        run, "number long, doc_id long, score long")


def _rank(found: DataFrame, k: int) -> DataFrame:
    return top_k(found, k, F.desc("score"), F.asc_nulls_last("doc_id"), by="number")


def _search_part(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    asked = terms.orderBy("number", "term").toPandas()  # at most TERMS_AT_ONCE, or one item
    number, term = asked["number"].to_numpy(np.int64), asked["term"].to_numpy(np.int64)
    known = np.unique(term.view(np.uint64))
    counts = count_terms(docs, known)
    total = counts.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"),
                       F.sum("n").alias("terms")).first()
    found = (counts.select(F.explode("place").alias("place")).groupBy("place").count()
             .toPandas())  # one row per term asked for
    df = np.zeros(len(known), np.int64)
    df[found["place"].to_numpy(np.int64)] = found["count"].to_numpy(np.int64)
    n_docs, n_terms = int(total["docs"]), int(total["terms"] or 0)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)
    numbers, starts = np.unique(number, return_index=True)
    request = Request(numbers, np.append(starts, len(number)),
                      np.searchsorted(known, term.view(np.uint64)), weights, n_docs, n_terms,
                      np.zeros(len(numbers), np.int64))
    some = counts.where(F.pmod(F.xxhash64(F.lit(13), "doc_id", "n"), F.lit(FLOOR_ONE_IN)) == 0)
    last = _rank(search_counts(some, request, k), k).where(F.col("rank") == k).toPandas()
    request.floors[np.searchsorted(numbers, last["number"].to_numpy(np.int64))] = (
        last["score"].to_numpy(np.int64))
    return _rank(search_counts(counts, request, k), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP,
                   terms_at_once: int = TERMS_AT_ONCE) -> DataFrame:
    """The ``k`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs``: doc_id, text; ``items``: item_id, text.  Terms are runs of digits,
    letters and characters from U+0080 on, with A-Z lowered; a null text has none.
    N documents have a term, L is the number of all their terms, n that of one; a
    term's weight is floor(1000 * ln((2 * N + 2) / (2 * df + 1))), and a document's
    score the sum, over the item's distinct terms, of weight * (10**9 * tf div
    (1000 * tf + 20 * m)) with m = 50 + (50 * n * N) div L.  Only scores above 0 count.
    Equal scores go by ascending doc_id, null ids last.

    Every row of ``docs`` is a document and every row of ``items`` an item, repeated
    ids and rows too; rows alike in score and id are interchangeable.  An item
    without terms, and one whose terms no document has, gets no row; an empty table
    gives an empty result.  Other columns are not read.
    """
    numbered, terms = number_items(items)
    parts = max(1, -(-terms.count() // terms_at_once))
    docs = texts(docs)
    ranked = None
    for part in range(parts):
        own = terms.where(F.pmod(F.xxhash64("number"), F.lit(parts)) == part)
        best = _search_part(docs, own, k)
        ranked = best if ranked is None else ranked.unionByName(best)
    return ranked.join(numbered, "number").select("item_id", "rank", "doc_id", "score")
