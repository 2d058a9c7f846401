"""Near-duplicate documents by one-permutation MinHash.

A text is the set of its distinct 5-word shingles.  Texts with equal sets are
one class first, named by its least id, so copies are never compared.  One hash
of every shingle deals the set into ``BINS`` bins; the least hash of a bin is
its entry, and an empty bin takes the entry of a full one along a fixed random
sequence (optimal densification).  ``BANDS`` bands of ``ROWS`` entries are the
buckets.  Two sets of similarity 0.75 share none with a chance of 2e-5.

In a bucket every class is paired with the bucket's least id only, a star.  The
share of equal entries drops pairs that are far below the limit, the others are
confirmed on their full sets, and components follow from the confirmed links.

A star misses a link between two classes that are both unlike its centre.  So
where a bucket holds classes of several components, those outside its largest
one are strangers to that component.  The strangers of a component are compared,
on full sets, with its members and with each other: in tiles of bounded size,
each a table of overlaps computed at once that hands on the links only.  So no
pair of a bucket goes unchecked, and no pairs are listed to check them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.tables import is_empty, map_texts, texts, unused
from larder.llm.words import Words, mix, rolled, seeds
from larder.session import materialise

SHINGLE = 5
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
PER_CENT = 75
SLACK = 0.15  # below the limit, nearly five standard deviations of a share of 200 entries
PAIR_ROWS = 250  # to Python at a time, as a row may hold two sets of a long text
TILE_SETS = 128  # about, on either side of a tile
TILE_BYTES = 1 << 20  # about, of the sets on either side
BROADCAST_IDS = 500_000  # at most; beyond, texts are joined by a shuffle
SHINGLE_BASE = 0xA0761D6478BD642F
SHORT_BASE = 0xE7037ED1A0B428DB
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each shingle, sorted by both, without repeats.

    A text of fewer words has the sequence of all of them as its only shingle.
    """
    hashes = words.hashes(lower=True)
    starts = words.window_starts(size)
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    text = np.concatenate([words.text[starts], few])
    value = np.concatenate([
        rolled(hashes, starts, starts + size, SHINGLE_BASE),
        rolled(hashes, words.first[few], words.first[few + 1], SHORT_BASE)])
    order = np.argsort(text, kind="stable")
    text, value = text[order], value[order]
    edges = np.searchsorted(text, np.arange(words.texts + 1))
    distinct = [np.unique(value[low:high]) for low, high in zip(edges[:-1], edges[1:])]
    return (np.repeat(np.arange(words.texts), [len(d) for d in distinct]),
            np.concatenate(distinct) if distinct else value)


def probes(bins: int, tries: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Where an empty bin looks: at random bins, and after those tries at the filled bin
    that comes first in an order of its own."""
    steps = np.arange(tries * bins, dtype=np.uint64).reshape(tries, bins)
    random = mix(steps + np.uint64(0x1234567)) % np.uint64(bins)
    pairs = np.arange(bins * bins, dtype=np.uint64).reshape(bins, bins)
    order = mix(pairs + np.uint64(0x7654321)).argsort(axis=1).argsort(axis=1)
    return random.astype(np.int64), order.astype(np.uint16)


PROBES, ORDERS = probes(BINS)
ENTRY_CODES = seeds(BINS, 77)


def entries(text: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """The densified entries of ``texts`` sets, one row each; no set is empty."""
    sketch = np.full(texts * BINS, EMPTY)
    place = ((value >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    np.minimum.at(sketch, text * BINS + place.astype(np.int64), mix(value) >> np.uint64(1))
    sketch = sketch.reshape(texts, BINS)
    filled, full = sketch.copy(), sketch != EMPTY
    for probe in PROBES:
        open_rows = np.flatnonzero((filled == EMPTY).any(axis=1))
        if not len(open_rows):
            return filled
        part, offered = filled[open_rows], sketch[open_rows][:, probe]
        filled[open_rows] = np.where((part == EMPTY) & full[open_rows][:, probe], offered, part)
    row, place = np.nonzero(filled == EMPTY)  # of sets with few filled bins
    for at in range(0, len(row), 1 << 14):
        some, bins = row[at:at + (1 << 14)], place[at:at + (1 << 14)]
        first = np.where(full[some], ORDERS[bins], BINS).argmin(axis=1)
        filled[some, bins] = sketch[some, first]
    return filled


def _sets(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    text, value = shingles(words)
    sizes = np.bincount(text, minlength=words.texts)
    some = np.flatnonzero(sizes)
    renumbered = np.cumsum(sizes > 0) - 1
    filled = entries(renumbered[text], value, len(some))
    coded = (filled * ENTRY_CODES).reshape(len(some), BANDS, ROWS).sum(axis=2, dtype=np.uint64)
    keys = mix(mix(coded) + np.arange(1, BANDS + 1, dtype=np.uint64))
    first = np.searchsorted(text, some)
    digests = [np.zeros(words.texts, np.uint64) for _ in range(2)]
    for digest, salt in zip(digests, (3, 5)):
        if len(some):
            digest[some] = np.add.reduceat(mix(value + np.uint64(salt)), first)
    per_row = np.where(sizes > 0, BANDS, 0)
    lists = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32)),
        pa.array(keys.reshape(-1).view(np.int64)))
    low = (mix(filled) & np.uint64(255)).astype(np.uint8)
    sketches = [None] * words.texts
    for i, row in zip(some.tolist(), low):
        sketches[i] = row.tobytes()
    return pa.RecordBatch.from_pydict({
        "doc_id": batch.column("doc_id"), "n_shingles": pa.array(sizes.astype(np.int64)),
        "d1": pa.array(digests[0].view(np.int64)), "d2": pa.array(digests[1].view(np.int64)),
        "keys": lists, "sketch": pa.array(sketches, pa.binary())})


def _full_sets(batch: pa.RecordBatch, words: Words) -> pa.RecordBatch:
    text, value = shingles(words)
    edges = np.searchsorted(text, np.arange(words.texts + 1))
    raw = value.tobytes()
    return pa.RecordBatch.from_pydict({
        "id": batch.column("doc_id"),
        "members": pa.array([raw[8 * low:8 * high] for low, high in zip(edges[:-1], edges[1:])],
                            pa.binary())})


def alike(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) whose sketches agree in ``least`` or more, with that share."""
    def run(batches):
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8)
                           .reshape(-1, BINS) for c in ("sa", "sb"))
            share = (left == right).mean(axis=1)
            keep = pa.array(np.flatnonzero(share >= least))
            yield pa.RecordBatch.from_pydict({
                "a": batch.column("a").take(keep), "b": batch.column("b").take(keep),
                "share": pa.array(share).take(keep)})

    joined = (pairs.join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b")
              .join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a"))
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, share double")


def confirm(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """``pairs`` (a, b) whose full sets are alike enough."""
    def run(batches):
        for batch in batches:
            keep = []
            for i, (left, right) in enumerate(zip(batch.column("ma"), batch.column("mb"))):
                left, right = (np.frombuffer(m.as_buffer(), np.uint64) for m in (left, right))
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= per_cent * (len(left) + len(right) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    joined = (pairs.select("a", "b")
              .join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
              .join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a"))
    return joined.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, members`` of the documents ``ids`` (id): their shingles, sorted, 8 bytes each."""
    ids = materialise(ids.select(F.col("id").alias("doc_id")).distinct(), "near-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return materialise(map_texts(docs.join(ids, "doc_id", "left_semi"), _full_sets,
                                 "id long, members binary"), "near-sets")


def attached(members: DataFrame, found: DataFrame) -> DataFrame:
    """``grp, id``: the strangers of each component that shares a bucket with them."""
    held = members.join(found, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    parts = held.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("parts")
    ).where("parts > 1").select("key", F.col("main.component").alias("grp"))
    return held.join(main, "key").where("component <> grp").select("grp", "id").distinct()


def tiled(rows: DataFrame, side: str) -> DataFrame:
    """``rows`` (grp, id, component, members) packed into numbered blocks of each group."""
    blocks = rows.groupBy("grp").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE_SETS),
        F.ceil(F.sum(F.length("members")) / TILE_BYTES)).cast("int").alias(f"{side}_n"))
    dealt = rows.join(blocks, "grp").withColumn(
        side, F.pmod(F.xxhash64("id"), F.col(f"{side}_n")).cast("int"))
    return dealt.groupBy("grp", f"{side}_n", side).agg(
        F.collect_list(F.struct("id", "component", "members")).alias(f"{side}_sets"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all ``left`` with all ``right`` sets."""
    owner = np.repeat(np.arange(len(right)), [len(r) for r in right])
    values = np.concatenate(right)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for i, own in enumerate(left):
        low, high = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
        n = high - low
        at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[i] = np.bincount(owner[at], minlength=len(right))
    return out


def tile_links(per_cent: int):
    """Of every tile the links, one for each stranger and component it meets."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sides = [[(e["id"], e["component"], np.frombuffer(e["members"], np.uint64))
                          for e in row[k]] for k in ("stranger_sets", "member_sets")]
                both = overlaps(*([e[2] for e in side] for side in sides))
                sizes = [np.array([len(e[2]) for e in side]) for side in sides]
                union = sizes[0][:, None] + sizes[1][None, :] - both
                links = {}
                for i, j in np.argwhere(100 * both >= per_cent * union).tolist():
                    (a, own, _), (b, other, _) = sides[0][i], sides[1][j]
                    if own != other:
                        links.setdefault((a, other), b)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array([min(a, b) for (a, _), b in links.items()], pa.int64()),
                    "b": pa.array([max(a, b) for (a, _), b in links.items()], pa.int64())})

    return run


def stranger_links(docs: DataFrame, members: DataFrame, found: DataFrame, per_cent: int
                   ) -> DataFrame | None:
    """Links that the stars missed, or None if no bucket holds two components."""
    strangers = materialise(attached(members, found), "near-strangers")
    if is_empty(strangers):
        return None
    groups = strangers.select("grp").distinct()
    inside = found.select(F.col("component").alias("grp"), "id").join(groups, "grp").union(
        groups.select("grp", F.col("grp").alias("id"))).union(strangers).distinct()
    sets = full_sets(docs, inside.select("id"))

    def with_sets(rows: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left").select(
            "grp", "id", F.coalesce("component", "id").alias("component")).join(sets, "id")

    left = tiled(with_sets(strangers), "stranger").drop("stranger_n")
    right = tiled(with_sets(inside), "member")
    numbers = right.select("grp", "member_n").distinct()
    left = left.join(numbers, "grp").withColumn(
        "member", F.explode(F.sequence(F.lit(0), F.col("member_n") - 1))).drop("member_n")
    tiles = left.join(right.drop("member_n"), ["grp", "member"]).select(
        "stranger_sets", "member_sets")
    return materialise(tiles.mapInArrow(tile_links(per_cent), "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text).

    Two documents are linked when their distinct 5-word shingles of words in
    lower-case A-Z overlap by ``per_cent`` or more of their union.  Returns one
    row per row of ``docs``: doc_id, n_shingles, class_id (the least id with the
    same set), component_id (the least id reachable over links) and kept (doc_id =
    component_id).

    Null and empty texts have no shingles and are linked with nothing.  Rows with
    a null id are linked with nothing; their class_id and component_id are null
    and they are kept.  Rows of one id with equal texts come out alike; with
    different texts they are one node of the graph.  An empty table gives an
    empty result.
    """
    docs = texts(docs, batch_rows=PAIR_ROWS)
    rows = materialise(map_texts(docs, _sets, "doc_id long, n_shingles long, d1 long, d2 long, "
                                 "keys array<bigint>, sketch binary"), "near-sketches")
    named = rows.where("doc_id is not null and n_shingles > 0")
    classes = named.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classed = materialise(
        named.select("doc_id", "n_shingles", "d1", "d2").join(
            classes, ["d1", "d2", "n_shingles"]).select("doc_id", "n_shingles", "class_id"),
        "near-classes")
    first = classed.where("doc_id = class_id").select("doc_id").distinct()
    heads = materialise(
        named.select("doc_id", "keys", "sketch").join(first, "doc_id").select(
            F.col("doc_id").alias("id"), "keys", "sketch"), "near-heads")
    buckets = heads.select("id", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(
        F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last")
    members = materialise(
        buckets.join(shared.select("key", "centre"), "key"), "near-members")
    sketches = heads.select("id", "sketch")
    stars = materialise(alike(
        members.where("centre <> id").select(F.col("centre").alias("a"), F.col("id").alias("b"))
        .distinct(), sketches, per_cent / 100 - SLACK), "near-stars")
    sets = full_sets(docs, stars.select(F.col("a").alias("id")).union(stars.select("b")))
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a"))
    links = materialise(confirm(best, sets, per_cent), "near-links")
    found = components(links, "near")
    left, right = (found.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
                   for end in "ab")
    others = (stars.join(best, ["a", "b"], "left_anti").join(left, "a", "left")
              .join(right, "b", "left")
              .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))
    more = materialise(confirm(others, sets, per_cent), "near-links")
    if not is_empty(more):
        links = links.unionByName(more)
        found = components(links, "near")
    missed = stranger_links(docs, members.select("key", "id"), found, per_cent)
    if missed is not None and not is_empty(missed):
        found = components(links.unionByName(missed), "near")
    named = classed.join(
        found.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select(
        "doc_id", "n_shingles", "class_id",
        F.coalesce("component", "class_id").alias("component_id"))
    alone = rows.where("doc_id is null or n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("class_id"),
        F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, per_cent: int = PER_CENT) -> DataFrame:
    """The rows of ``docs`` without the near-duplicates of a smaller id.

    Of rows with one id and text only one stays; rows with a null id all stay.  All
    columns are kept, whatever their names.
    """
    kept_id, digest = unused(docs, "_kept"), unused(docs, "_text")
    kept = near_duplicates(docs, per_cent).where("kept and doc_id is not null").select(
        F.col("doc_id").alias(kept_id)).distinct()
    named = docs.join(kept, docs["doc_id"] == F.col(kept_id), "left_semi")
    one = named.withColumn(digest, F.sha2(named["text"].cast("string"), 256)).dropDuplicates(
        ["doc_id", digest]).drop(digest)
    return one.unionByName(docs.where(docs["doc_id"].isNull()))
