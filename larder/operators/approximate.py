"""Approximate nearest neighbours from product-quantised residuals (Jegou et al. 2011).

A vector is stored as its cell and one byte per group of dimensions, the nearest
entry of that group's codebook to its difference from the cell's centre.  Centres and
codebooks are fitted on a bounded sample; every vector is encoded.  A query visits the
cells of its nearest centres, where its distances to all codes are sums of table
look-ups; the best candidates are compared again by their vectors.  How many cells are
needed for a recall is measured on the sample.

Cells travel in bundles of bounded size, codes beside vectors.  A query is sent once to
every bundle that has one of its cells, and the bundle hands on its k best after the
second comparison, so candidates are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.operators.neighbours import (
    METRICS, _bundles, _gaps, _metric_space, _pivots, _rank, _small_table, _stack, _unit, _unpack,
    in_lanes)
from larder.session import materialise

CELL_ROWS = 256
MAX_CELLS = 2048
GROUP = 4             # dimensions that share a byte
WORDS = 256           # entries of a codebook
ROUNDS = 8            # of k-means
BLOCK_CODES = 1 << 18
TABLE_BYTES = 64 << 20  # of look-up results held at a time in a task
STRIP_ROWS = 1024       # queries looked up at a time
REFINE = 32           # candidates compared again, times k
RECALL = 0.97         # aimed at by ``probes_for``
AUDIT = 512           # rows of the sample that measure it


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centres at most, started from the first distinct rows."""
    if not len(rows):
        return rows
    first = np.sort(np.unique(rows, axis=0, return_index=True)[1])[:k]
    centres = rows[first].copy()
    for _ in range(rounds):
        nearest = _gaps(rows, centres).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, rows)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


@dataclass(frozen=True)
class ApproximateIndex:
    codes: DataFrame          # bundle, slot (cell), index, code, vec (packed)
    metric: str
    reach: float
    centres: np.ndarray
    books: list[np.ndarray]   # per group of dimensions: entries x dimensions
    bundled: np.ndarray       # per bundle and cell in it: the bundle
    cell_of: np.ndarray       # and the cell
    places: np.ndarray        # per sampled neighbour, how many cells come before its own

    def probes_for(self, recall: float = RECALL) -> int:
        """Cells to visit so that this share of the sample's neighbours lies in them."""
        if not len(self.places):
            return len(self.centres)
        return int(np.quantile(self.places, recall, method="higher")) + 1


def _split(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, max(1, rows.shape[1] // GROUP), axis=1)


def build_approximate(vectors: DataFrame, metric: str = "l2", max_cells: int = MAX_CELLS,
                      k: int = 5) -> ApproximateIndex:
    """Encode ``index, vec`` rows; keys are unique.  By cosine, zero vectors are left out."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    if metric == "cosine":
        vectors = vectors.where("exists(vec, x -> x <> 0)")
    sample, _, reach, _ = _pivots(vectors, metric, 1)
    n = vectors.count()
    centres = k_means(sample, max(1, min(max_cells, n // CELL_ROWS, len(sample) // 8)))
    own = _gaps(sample, centres).argmin(axis=1) if len(sample) else np.zeros(0, np.int64)
    books = [k_means(part, WORDS) for part in _split(sample - centres[own])] if len(sample) else []
    # true neighbours within the sample, and the place of their cell for the query
    some = sample[:AUDIT]
    apart = _gaps(some, sample)
    apart[np.arange(len(some)), np.arange(len(some))] = np.inf
    near = np.argsort(apart, axis=1, kind="stable")[:, :min(k, max(len(sample) - 1, 0))]
    order = np.argsort(np.argsort(_gaps(some, centres), axis=1, kind="stable"), axis=1)
    places = np.take_along_axis(order, own[near], axis=1).ravel() if near.size else np.zeros(0)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                packed = _stack(batch["vec"])
                rows = _metric_space(packed.astype(np.float64), metric, reach, False)
                cell = _gaps(rows, centres).argmin(axis=1)
                code = np.stack([_gaps(part, book).argmin(axis=1) for part, book in zip(
                    _split(rows - centres[cell]), books)], axis=1).astype(np.uint8)
                yield pd.DataFrame({
                    "slot": cell.astype(np.int32), "index": batch["index"],
                    "code": [c.tobytes() for c in code], "vec": [r.tobytes() for r in packed]})

    encoded = materialise(vectors.select("index", "vec").mapInPandas(
        encode, "slot int, index long, code binary, vec binary"), "codes")
    sizes = {r["slot"]: r["count"] for r in encoded.groupBy("slot").count().collect()}
    blocks = np.array([-(-sizes.get(c, 1) // BLOCK_CODES) for c in range(len(centres))], np.int64)
    n = np.array([sizes.get(c, 0) for c in range(len(centres))], np.int64)
    nothing = np.zeros(len(centres))
    cell_of, block_of, bundled = _bundles(
        np.arange(len(centres)), nothing, n, blocks, centres, BLOCK_CODES)
    spark = vectors.sparkSession
    numbers = _small_table(spark, "slot int, blocks long", range(len(blocks)), blocks.tolist())
    places_of = _small_table(spark, "slot int, block int, bundle int", cell_of.tolist(),
                             block_of.tolist(), bundled.tolist())
    codes = encoded.join(numbers, "slot").withColumn(
        "block", F.pmod(F.xxhash64("index"), F.col("blocks")).cast("int")).join(
        places_of, ["slot", "block"]).select("bundle", "slot", "index", "code", "vec")
    return ApproximateIndex(codes, metric, reach, centres, books, bundled, cell_of, places)


def _distances(ours: np.ndarray, theirs: np.ndarray, metric: str) -> np.ndarray:
    """The distances of matching rows, as ``knn`` defines them."""
    if metric == "l2":
        return np.sqrt(((ours - theirs) ** 2).sum(axis=1))
    if metric == "cosine":
        return 1.0 - np.einsum("ij,ij->i", _unit(ours), _unit(theirs))
    return -np.einsum("ij,ij->i", ours, theirs)


def approximate_knn(queries: DataFrame, index: ApproximateIndex, k: int = 5,
                    probes: int | None = None, refine: int = REFINE) -> DataFrame:
    """``query_id, rank, index, distance`` of about the k nearest vectors per query.

    ``queries`` has ``query_id, vec`` with unique keys.  ``probes`` cells are visited
    (by default as many as ``probes_for`` names) and ``refine * k`` candidates compared
    by their vectors, so distances are exact; with all cells and enough candidates the
    result is that of ``knn``.
    """
    metric, reach, centres, books = index.metric, index.reach, index.centres, index.books
    cell_of = index.cell_of
    queries = queries.where("query_id IS NOT NULL")
    if metric == "cosine":
        queries = queries.where("exists(vec, x -> x <> 0)")
    key = queries.schema["query_id"].dataType.simpleString()
    result = f"query_id {key}, index long, millionths long"
    probes = min(len(centres), probes or index.probes_for())
    if not len(centres):
        return _rank(queries.sparkSession.createDataFrame([], result), k)
    first = np.flatnonzero(np.diff(index.bundled, prepend=-1))

    def nearest_cells(rows: np.ndarray) -> np.ndarray:
        """Whether a query visits each cell."""
        gaps = _gaps(_metric_space(rows, metric, reach, True), centres)
        seen = np.zeros(gaps.shape, bool)
        np.put_along_axis(seen, np.argpartition(gaps, probes - 1, axis=1)[:, :probes], True, 1)
        return seen

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), STRIP_ROWS):
                part = batch.iloc[at:at + STRIP_ROWS]
                packed = _stack(part["vec"])
                seen = nearest_cells(packed.astype(np.float64))
                row, bundle = np.nonzero(
                    np.logical_or.reduceat(seen[:, cell_of], first, axis=1))
                yield pd.DataFrame({
                    "bundle": bundle.astype(np.int32),
                    "query_id": part["query_id"].to_numpy()[row],
                    "vec": np.array([r.tobytes() for r in packed], dtype=object)[row]})

    best = refine * k

    def look_up(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": left["query_id"].iloc[:0],
                             "index": pd.Series(dtype="int64"),
                             "millionths": pd.Series(dtype="int64")})]
        if not len(left) or not len(right):
            return out[0]
        right = right.sort_values(["slot", "index"], kind="stable")
        cells, start = np.unique(right["slot"].to_numpy(), return_index=True)
        end = np.append(start[1:], len(right))
        codes = np.frombuffer(b"".join(right["code"]), np.uint8).reshape(len(right), -1).T
        ids, theirs = right["index"].to_numpy(), _unpack(right["vec"])
        # rows that repeat a key meet as in a join on the keys
        alike, same = (_copies(keys) for keys in (left["query_id"].to_numpy(), ids))
        # of a query at most ``best`` candidates of a cell, and of all its cells
        strip = max(1, min(STRIP_ROWS, TABLE_BYTES // (48 * best * min(probes, len(cells)))))
        for at in range(0, len(left), strip):
            part = left.iloc[at:at + strip]
            ours, asked = _unpack(part["vec"]), part["query_id"].to_numpy()
            spaced = _metric_space(ours, metric, reach, True)
            seen = nearest_cells(ours)[:, cells]
            found = []
            for place, (cell, low, high) in enumerate(zip(cells, start, end)):
                visitors = np.flatnonzero(seen[:, place])
                step = max(1, TABLE_BYTES // (32 * (high - low)))
                for of in range(0, len(visitors), step):
                    some = visitors[of:of + step]
                    about = np.zeros((len(some), high - low))
                    for own, book, code in zip(
                            _split(spaced[some] - centres[cell]), books, codes):
                        about += (_gaps(own, book) ** 2)[:, code[low:high]]
                    row, column = _least_of(about, best)
                    found.append((some[row], low + column, about[row, column]))
            row, column, about = (np.concatenate(x) for x in zip(*found)) if found else (
                np.zeros(0, np.int64),) * 3
            order = np.lexsort((ids[column], about, row))
            row, column = row[order], column[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < best
            row, column = row[kept], column[kept]
            value = np.zeros(len(row))
            step = max(1, TABLE_BYTES // (32 * ours.shape[1]))
            for low in range(0, len(row), step):
                value[low:low + step] = _distances(
                    ours[row[low:low + step]], theirs[column[low:low + step]], metric)
            value = np.floor(value * 1e6 + 0.5).astype(np.int64)
            order = np.lexsort((ids[column], value, row))
            row, column, value = row[order], column[order], value[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, column, value = row[kept], column[kept], value[kept]
            n = np.minimum(k, (alike[at + row] * same[column]))
            out.append(pd.DataFrame({
                "query_id": np.repeat(asked[row], n), "index": np.repeat(ids[column], n),
                "millionths": np.repeat(value, n)}))
        return pd.concat(out)

    visits, codes = in_lanes(
        queries.select("query_id", "vec").mapInPandas(
            visit, f"bundle int, query_id {key}, vec binary"),
        index.codes, queries.count(), BLOCK_CODES)
    keys = ["bundle", "lane"]
    found = visits.groupBy(*keys).cogroup(codes.groupBy(*keys)).applyInPandas(look_up, result)
    return _rank(found, k)


def _copies(keys: np.ndarray) -> np.ndarray:
    """How many of ``keys`` equal each."""
    _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[place]


def _least_of(about: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``n`` least entries of every row."""
    if about.shape[1] <= n:
        return tuple(x.ravel() for x in np.indices(about.shape))
    column = np.argpartition(about, n - 1, axis=1)[:, :n]
    return np.repeat(np.arange(len(about)), n), column.ravel()


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``n_true, n_found, recall``, of the neighbours of ``exact`` those ``found``."""
    both = exact.select("query_id", "index").join(
        found.select("query_id", "index", F.lit(1).alias("hit")), ["query_id", "index"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found")).withColumn(
        "recall", F.try_divide("n_found", "n_true"))
