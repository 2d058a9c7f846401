"""Removal of long word runs that a document with a smaller id has too.

Runs of ``SPAN`` words are the edges of a de Bruijn graph over word sequences.
Listing every edge would be several times the text, so edges are named by the
path they lie on.  Each edge has an anchor, the ``ANCHOR``-word run in it with
the least hash; equal edges have equal anchors at equal places.  Consecutive
edges of a document with one anchor form a path, about twenty edges long, and
equal paths are one node of the compacted graph.  Three Spark joins settle them:

* a path that a smaller document has as a whole is removed as a whole;
* a path whose anchor is in no smaller document stays;
* for the others, where documents branch off inside a path, the edges of one
  occurrence of each distinct path are read at their source coordinates, in the
  text itself, and compared edge by edge.

An edge is compared by two independent 64-bit hashes, of its anchor and of all
its words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.tables import map_texts, texts
from larder.llm.words import Words, mix, rolled, windows
from larder.session import materialise

SPAN = 50
ANCHOR = 12
ANCHOR_BASE = 0x9FB21C651E98DF25
EDGE_BASE = 0xD6E8FEB86659FD93


def paths(words: Words, span: int, anchor: int) -> dict[str, np.ndarray]:
    """The paths of a slice: text, first edge, number of edges, anchor and path hash."""
    starts = words.window_starts(span)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return {"text": empty, "first": empty, "edges": empty,
                "anchor": empty.astype(np.uint64), "path": empty.astype(np.uint64)}
    hashes = words.hashes()
    grams = windows(hashes, np.arange(len(hashes) - anchor + 1), anchor, ANCHOR_BASE)
    per_edge = np.lib.stride_tricks.sliding_window_view(grams, span - anchor + 1)
    least = starts + per_edge[starts].argmin(axis=1) if len(starts) < len(per_edge) \
        else starts + per_edge.argmin(axis=1)
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(starts) != 1)
    begin = np.flatnonzero(new)
    edges = np.diff(np.append(begin, len(starts)))
    first = starts[begin]
    return {
        "text": words.text[first], "first": first - words.first[words.text[first]],
        "edges": edges, "anchor": grams[least[begin]],
        "path": mix(rolled(hashes, first, first + edges + span - 1, EDGE_BASE)
                    ^ edges.astype(np.uint64)),
    }


def long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def path_rows(docs: DataFrame, span: int, anchor: int) -> DataFrame:
    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        found = paths(words, span, anchor)
        rows = pa.array(found["text"])
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(rows), "mark": batch.column("mark").take(rows),
            **{k: long(found[k]) for k in ("first", "edges", "anchor", "path")}})

    return map_texts(docs, task,
                     "doc_id long, mark long, first long, edges long, anchor long, path long")


def edge_rows(docs: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """Every edge of the ``wanted`` occurrences, read from the text: anchor, path, at, edge."""
    wanted = wanted.groupBy("doc_id", "mark").agg(F.collect_list(
        F.struct("anchor", "path", "first", "edges")).alias("spans"))

    def task(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
        spans = batch.column("spans")
        text = np.repeat(np.arange(len(batch)), spans.value_lengths().to_numpy())
        spans = spans.flatten()
        field = {k: spans.field(k).to_numpy() for k in ("anchor", "path", "first", "edges")}
        at = np.arange(field["edges"].sum()) - np.repeat(
            np.cumsum(field["edges"]) - field["edges"], field["edges"])
        each = {k: np.repeat(v, field["edges"]) for k, v in field.items()}
        start = words.first[np.repeat(text, field["edges"])] + each["first"] + at
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(np.repeat(text, field["edges"]))),
            "anchor": long(each["anchor"]), "path": long(each["path"]), "at": long(at),
            "edge": long(windows(words.hashes(), start, span, EDGE_BASE))})

    return map_texts(docs.join(wanted, ["doc_id", "mark"]), task,
                     "doc_id long, anchor long, path long, at long, edge long")


def repeated_spans(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, mark, cuts``: for every document, the word ranges that smaller ids have."""
    occurrences = materialise(path_rows(docs.where("doc_id is not null"), span, anchor), "paths")
    nodes = occurrences.groupBy("anchor", "path").agg(
        F.min(F.struct("doc_id", "mark", "first", "edges")).alias("source"),
        F.max("doc_id").alias("last"))
    anchors = nodes.groupBy("anchor").agg(
        F.min("source.doc_id").alias("smallest"), F.max("last").alias("largest"),
        F.count(F.lit(1)).alias("n_paths")).where("smallest < largest")
    nodes = materialise(nodes.join(anchors, "anchor").select(
        "anchor", "path", "source.*", "smallest", "n_paths"), "path-nodes")
    branching = nodes.where("n_paths > 1").select(
        "anchor", "path", "doc_id", "mark", "first", "edges")
    edges = materialise(edge_rows(docs, branching, span), "edges")
    least = edges.groupBy("anchor", "edge").agg(
        F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last")
    inner = (edges.join(least, ["anchor", "edge"]).where("least < doc_id")
             .groupBy("anchor", "path").agg(F.collect_list("at").alias("removed")))
    settled = nodes.join(inner, ["anchor", "path"], "left").select(
        "anchor", "path", F.col("doc_id").alias("owner"), "removed")
    whole = F.array(F.struct(F.col("first").alias("start"),
                             (F.col("first") + F.col("edges") + span - 1).alias("end")))
    parts = F.transform("removed", lambda at: F.struct(
        (F.col("first") + at).alias("start"), (F.col("first") + at + span).alias("end")))
    cuts = F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(
        F.coalesce(parts, F.array().cast("array<struct<start:bigint,end:bigint>>")))
    return (occurrences.join(settled, ["anchor", "path"]).select("doc_id", "mark", cuts.alias("c"))
            .where(F.size("c") > 0).groupBy("doc_id", "mark")
            .agg(F.flatten(F.collect_list("c")).alias("cuts")))


def _cut(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    spans = batch.column("cuts")
    lengths = np.nan_to_num(spans.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    base = np.repeat(words.first[:-1], lengths)
    flat = spans.flatten()
    edges = np.zeros(len(words.start) + 1, np.int64)
    np.add.at(edges, base + flat.field("start").to_numpy(), 1)
    np.add.at(edges, base + flat.field("end").to_numpy(), -1)
    keep = np.cumsum(edges)[:-1] == 0
    raw, kept = words.data.tobytes(), []
    start, end = words.start.tolist(), words.end.tolist()
    for i in range(words.texts):
        low, high = words.first[i], words.first[i + 1]
        if keep[low:high].all():
            kept.append(b" ".join(raw[words.offsets[i]:words.offsets[i + 1]].split()))
        else:
            kept.append(b" ".join(
                raw[start[j]:end[j]] for j in (np.flatnonzero(keep[low:high]) + low).tolist()))
    removed = np.add.reduceat(np.append(~keep, False), words.first[:-1]) * (words.counts > 0)
    return pa.RecordBatch.from_pydict({
        "doc_id": batch.column("doc_id"), "n_words": long(words.counts),
        "n_removed": long(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())})


def remove_repeats(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """Every document without the words that a smaller document's ``span`` words cover.

    ``docs``: doc_id, text.  A word goes if some ``span`` consecutive words with
    it are, as a sequence, also in a document with a smaller id; that is judged
    on the texts as given.  Returns one row per row of ``docs``: doc_id, n_words,
    n_removed and kept_text, the words left joined by one space.

    Null and empty texts have no words.  Texts under ``span`` words stay whole.
    Rows with a null id stay whole and make no other row lose words.  Rows of one
    id, equal or not, take nothing from each other, and each loses what smaller
    ids have.  Of an empty table the result is empty.  ``anchor`` changes the
    work, not the result.
    """
    docs = texts(docs).withColumn("mark", F.xxhash64("text"))
    cuts = repeated_spans(docs, span, anchor)
    joined = docs.join(cuts, ["doc_id", "mark"], "left")
    return map_texts(joined, _cut,
                     "doc_id long, n_words long, n_removed long, kept_text string")


def digest_column(df: DataFrame, text: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sha2(F.col(text), 256)).drop(text)
