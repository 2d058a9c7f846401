"""Full-text index and BM25 search.

The index is a table of posting lists by block of documents: one row per block
and term with the block's documents that hold it.  A document's score for a query
is then complete inside one block: only the block's top k of each query is
shuffled, and a term that occurs in every document is spread over all blocks.  A
batch of queries meets the lists by a broadcast join on the term, and a task
scores one block for all queries at once.  Of larger batches a task holds a part and
reads the blocks one after the other from their files: the best so far of a query are
its floor in the next block, and nothing but the result leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.functions.text import terms_of
from larder.session import materialise, materialise_bucketed, spread

# Robertson & Zaragoza 2009.
K1 = 1.2
B = 0.75

# A block holds about this many documents, or postings where they are long.
BLOCK_DOCS = 1_024
BLOCK_POSTINGS = 1 << 19
# Up to this many query terms are sent to every executor (some 100 bytes each); of more,
# a task holds about as many at most.
BROADCAST_ROWS = 500_000
RESULTS = 1 << 22  # rows of results that a task holds
# Scores of (query, document) cells, and postings of queries, held at a time in a task.
CELLS = 1 << 21
# A posting summed by itself takes as long as this many cells of a matrix product.
PRODUCT = 400
SLACK = 2e-6  # covers the rounding of scores, and sums in another order
# Lists of a query are merged alone if they have fewer postings than a block has documents,
# by this; those that bring documents to be completed by each term, by twice this.
SPARSE = 4
# Up to this many distinct terms of a batch are named in the filter as well, so
# that the scan skips the other pages.  Ten to a list: longer lists reach the
# Parquet reader as a range only.
NAMED_TERMS = 200
NAMED_TOGETHER = 10
# One block in this many gives every query a lower bound of its k-th score first.
SAMPLE_ONE_IN = 16


@dataclass(frozen=True)
class TextIndex:
    docs: DataFrame      # index, doc_len, terms: array<struct<term, tf>>
    blocks: DataFrame    # block, term, entries: array<struct<index, tf, doc_len>>
    term_df: DataFrame   # term, df
    n_docs: int
    n_blocks: int
    avg_len: float

    @property
    def postings(self) -> DataFrame:
        """``term, index, tf, doc_len``."""
        return self.blocks.select("term", F.explode("entries").alias("entry")).select(
            "term", "entry.index", "entry.tf", "entry.doc_len")


def term_counts(docs: DataFrame, key: str = "index", text: str = "text") -> DataFrame:
    """One row per document: ``index``, ``doc_len`` and its distinct terms.

    Counting happens inside the row over the sorted terms, so no token is
    shuffled.
    """
    ordered = docs.select(
        F.col(key).alias("index"), F.sort_array(terms_of(F.col(text))).alias("ordered"))
    first = ordered.withColumn("first", F.expr(
        "filter(if(size(ordered) = 0, array(), sequence(0, size(ordered) - 1)),"
        " i -> i = 0 or ordered[i] <> ordered[i - 1])"))
    return first.select(
        "index",
        F.size("ordered").alias("doc_len"),
        F.expr("transform(first, (at, n) -> struct(ordered[at] as term,"
               " coalesce(get(first, n + 1), size(ordered)) - at as tf))").alias("terms"))


def build_index(docs: DataFrame, key: str = "index", text: str = "text",
                buckets: int | None = None, block_docs: int = BLOCK_DOCS) -> TextIndex:
    """Index one text column.

    ``buckets`` defaults to the shuffle partitions or four per core; blocks follow
    the size of the table.
    """
    spark = docs.sparkSession
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                             4 * spark.sparkContext.defaultParallelism)
    counted = term_counts(spread(docs.select(key, text), key), key, text)
    stored = materialise_bucketed(counted, "docs", "index", buckets)
    totals = stored.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("len"),
                        F.sum(F.size("terms")).alias("entries")).first()
    n_blocks = max(1, -(-totals["n"] // block_docs), -(-(totals["entries"] or 0) // BLOCK_POSTINGS))
    # a block has a bounded number of documents, which travel whole, and so has a list
    lists = (stored.where(F.size("terms") > 0)
             .select(F.pmod(F.xxhash64("index"), F.lit(n_blocks)).alias("block"),
                     "index", "doc_len", "terms")
             .repartition(buckets, "block").groupBy("block")
             .applyInArrow(_lists_of_block, T.StructType([
                 T.StructField("block", T.LongType()), T.StructField("term", T.StringType()),
                 T.StructField("entries", T.ArrayType(T.StructType([
                     stored.schema["index"], T.StructField("tf", T.IntegerType()),
                     stored.schema["doc_len"]])))])))
    blocks = materialise_bucketed(lists, "blocks", "block", buckets, order=("block", "term"),
                                  placed=True)
    term_df = materialise(blocks.groupBy("term").agg(F.sum(F.size("entries")).alias("df")),
                          "term-df")
    return TextIndex(stored, blocks, term_df, totals["n"], n_blocks, totals["len"] or 0.0)


def _lists_of_block(table: pa.Table) -> pa.Table:
    """``block, term, entries`` of the documents of one block, a row per term."""
    table = table.combine_chunks()
    terms = table.column("terms").combine_chunks()
    if isinstance(terms, pa.ChunkedArray):
        terms = terms.chunk(0)
    entries, size = terms.flatten(), pc.list_value_length(terms).to_numpy(zero_copy_only=False)
    coded = entries.field("term").dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    row = pa.array(np.repeat(np.arange(len(size)), size)[order])
    n = np.bincount(code, minlength=len(coded.dictionary))
    lists = pa.ListArray.from_arrays(
        np.append(0, np.cumsum(n)).astype(np.int32), pa.StructArray.from_arrays([
            pa.concat_arrays(table.column("index").take(row).chunks),
            entries.field("tf").take(pa.array(order)),
            pa.concat_arrays(table.column("doc_len").take(row).chunks)],
            ["index", "tf", "doc_len"]))
    block = table.column("block").combine_chunks()[0].as_py()
    return pa.table({"block": pa.array(np.full(len(n), block)), "term": coded.dictionary,
                     "entries": lists})


def postings(docs: DataFrame) -> DataFrame:
    """``term, index, tf, doc_len`` of an index's documents."""
    return (docs.select("index", "doc_len", F.explode("terms").alias("entry"))
                .select("entry.term", "index", "entry.tf", "doc_len"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents, total and mean length, longest document."""
    return docs.agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("doc_len").alias("n_terms"),
        F.avg("doc_len").alias("avg_len"), F.max("doc_len").alias("max_len"))


def idf(df: Column, n_docs: int) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def query_terms(queries: DataFrame, index: TextIndex,
                query: str = "query") -> tuple[DataFrame, DataFrame]:
    """Numbered queries, and their distinct indexed terms with weights; both written.

    Scores are grouped by query number, which is cheaper than by a text key.
    """
    numbered = materialise(queries.select(
        F.monotonically_increasing_id().alias("number"), "query_id",
        F.array_distinct(terms_of(F.col(query))).alias("terms")), "queries")
    asked = numbered.select("number", F.explode("terms").alias("term"))
    weighted = index.term_df.join(asked, "term").select(
        "number", "term", "df", idf(F.col("df"), index.n_docs).alias("idf"))
    return numbered.select("number", "query_id"), materialise(weighted, "query-terms")


def _of_terms(blocks: DataFrame, terms: list[str]) -> DataFrame:
    """Only the lists of ``terms``, as filters that reach the scan."""
    groups = [terms[at:at + NAMED_TOGETHER] for at in range(0, len(terms), NAMED_TOGETHER)]
    return blocks.where(reduce(lambda a, b: a | b, [F.col("term").isin(g) for g in groups]))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(sizes.sum())


def _best_of_block(table: pa.Table, k: int, avg_len: float) -> pa.Table:
    """The block's top ``k`` of every query: ``number, index, score, matched``.

    ``table`` has a row per term: its list, and the queries that ask for it with
    weight and floor.
    """
    table = table.combine_chunks()
    entries, asked = (lists_of(table, name) for name in ("entries", "asked"))
    term = np.repeat(np.arange(table.num_rows), np.diff(asked["start"]))
    order = np.lexsort((term, asked["idf"], asked["number"]))
    numbers, first, query = np.unique(
        asked["number"][order], return_index=True, return_inverse=True)
    row, ids, score, matched = _score(entries, query, term[order], asked["idf"][order],
                                      asked["floor"][order][first], k, avg_len)
    return pa.table({"number": numbers[row], "index": ids, "score": score, "matched": matched})


def _score(entries: dict[str, np.ndarray], query: np.ndarray, term: np.ndarray,
           weight: np.ndarray, floor: np.ndarray, k: int, avg_len: float
           ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query, key, score and number of matched terms of a block's top ``k`` of every query.

    ``entries`` are the lists of the terms; ``query``, ``term`` and ``weight`` say which
    query asks for which, by query and rising weight.  A query is left out if its terms'
    greatest gains of the block sum up to less than its floor.  Of the others, lists that
    are short are merged.  The terms of least weight whose gains together stay below the
    floor bring no document by themselves, so it is enough that the other lists are short.
    Where they are long, terms that many queries ask for and many documents have are summed
    by a matrix product in single precision, and others list by list.  What comes near the
    best but was not summed over all terms as exactly is scored again.
    """
    ids, doc = np.unique(entries["index"], return_inverse=True)
    tf = entries["tf"].astype(float)
    gain = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * entries["doc_len"] / avg_len))
    start, size = entries["start"][:-1], np.diff(entries["start"])
    n_docs, n_queries = len(ids), len(floor)
    found = [(np.zeros(0, np.int64), ids[:0], np.zeros(0), np.zeros(0, np.int32))]
    if not len(query) or not n_docs:
        return found[0]
    # a document's gain by a term; a repeated id brings one for every row
    places, at_place, copies = np.unique(
        np.repeat(np.arange(len(size)), size) * n_docs + doc,
        return_inverse=True, return_counts=True)
    gains = np.bincount(at_place, gain)
    greatest = np.maximum.reduceat(
        gains, np.searchsorted(places, np.arange(len(size)) * n_docs))
    ends = np.searchsorted(query, np.arange(n_queries + 1))
    most = weight * greatest[term]
    total = np.bincount(query, most, n_queries)
    n_asks = np.diff(ends)
    able = (total >= floor) & (n_asks > 0)
    short = np.bincount(query, size[term], n_queries) * SPARSE <= n_docs
    # what a query can gain by its terms up to each, and by those that bring no document
    upto = np.cumsum(most)
    upto -= np.append(0.0, upto)[ends[:-1]][query]
    bring = short[query] | (upto >= floor[query] - SLACK)
    rest = np.bincount(query, np.where(bring, 0.0, most), n_queries)
    brought = np.bincount(query, np.where(bring, size[term], 0), n_queries)
    alone = able & (short | (brought * n_asks * 2 * SPARSE <= n_docs))
    full = able & ~alone

    def hand_on(row: np.ndarray, column: np.ndarray) -> None:
        """The best of some queries' documents, by all of their terms."""
        n = ends[row + 1] - ends[row]
        step = np.cumsum(n) // CELLS
        score, matched = np.zeros(len(row)), np.zeros(len(row), np.int32)
        for at in np.unique(step):
            own = step == at
            one = np.repeat(np.arange(own.sum()), n[own])
            asks = _ranges(ends[row[own]], n[own])
            wanted = term[asks] * n_docs + column[own][one]
            place = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
            has = places[place] == wanted
            score[own] = np.bincount(
                one, np.where(has, weight[asks] * gains[place], 0.0), own.sum())
            matched[own] = np.bincount(one, np.where(has, copies[place], 0), own.sum())
        hand_on_scored(row, column, score, matched)

    def hand_on_scored(row: np.ndarray, column: np.ndarray, score: np.ndarray,
                       matched: np.ndarray) -> None:
        score = np.round(score, 6)
        high = score >= floor[row]
        row, column, score, matched = row[high], column[high], score[high], matched[high]
        best = np.lexsort((column, -score, row))
        row, column, score, matched = row[best], column[best], score[best], matched[best]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[kept], ids[column[kept]], score[kept], matched[kept]))

    def merged(asks: np.ndarray) -> None:
        """Documents that the lists of ``asks`` bring."""
        n = size[term[asks]]
        pairs = _ranges(start[term[asks]], n)
        cell = np.repeat(query[asks] * n_docs, n) + doc[pairs]
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        if not len(first):
            return
        score = np.add.reduceat((np.repeat(weight[asks], n) * gain[pairs])[order], first)
        matched = np.diff(first, append=len(cell)).astype(np.int32)
        row, column = np.divmod(cell[first], n_docs)
        whole = rest[row] == 0.0
        hand_on_scored(row[whole], column[whole], score[whole], matched[whole])
        near = ~whole & (score + rest[row] >= floor[row] - SLACK)
        row, column, score = row[near], column[near], score[near]
        # the others bring no more than the rest to what is among the best without
        best = np.lexsort((-score, row))
        row, column, score = row[best], column[best], score[best]
        kth = np.searchsorted(row, row) + k - 1
        few = kth >= len(row)
        kth[few] = 0
        hand = few | (row[kth] != row) | (score + rest[row] >= score[kth] - SLACK)
        hand_on(row[hand], column[hand])

    asks = np.flatnonzero(alone[query] & bring)
    strip = np.cumsum(np.where(alone, np.maximum(brought, 1), 0)) // CELLS
    bounds = np.searchsorted(strip[query[asks]], np.arange(strip[-1] + 2))
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high > low:
            merged(asks[low:high])

    # terms by the product: a posting of a list costs as much as some cells of it
    shared = np.bincount(term, full[query], len(size)) * size * PRODUCT > full.sum() * n_docs
    if shared.sum() * n_docs > CELLS:
        shared &= np.cumsum(shared) * n_docs <= CELLS
    line = np.cumsum(shared) - 1
    dense = np.zeros((int(shared.sum()), n_docs))
    own = np.repeat(shared, size)
    np.add.at(dense, (np.repeat(line, size)[own], doc[own]), gain[own])
    dense = dense.astype(np.float32)
    # twice what the rounding of single precision can add up to
    slack = SLACK + (n_asks + 8) * 2.0 ** -22 * total
    limit = np.maximum(floor - slack, 1e-30).astype(np.float32)

    def scored(own: np.ndarray) -> np.ndarray:
        """Scores of all documents for the queries ``own``, up to the rounding."""
        place = np.full(n_queries, -1)
        place[own] = np.arange(len(own))
        asks = _ranges(ends[own], ends[own + 1] - ends[own])
        rows, terms, of = place[query[asks]], term[asks], weight[asks]
        by_product = shared[terms]
        lists = ~by_product
        pairs = _ranges(start[terms[lists]], size[terms[lists]])
        cell = np.repeat(rows[lists] * n_docs, size[terms[lists]]) + doc[pairs]
        score = np.bincount(cell, np.repeat(of[lists], size[terms[lists]]) * gain[pairs],
                            minlength=len(own) * n_docs).reshape(len(own), n_docs)
        score = score.astype(np.float32)
        if len(dense):
            weights = np.zeros((len(own), len(dense)), np.float32)
            weights[rows[by_product], line[terms[by_product]]] = of[by_product]
            score += weights @ dense
        return score

    cost = np.bincount(query, np.where(shared[term], 0, size[term]), n_queries)
    cost = np.maximum(cost, max(n_docs, len(dense)))
    strip = np.cumsum(np.where(full, cost, 0)) // CELLS
    for at in np.unique(strip[full]):
        own = np.flatnonzero(full & (strip == at))
        score = scored(own)
        near = score >= limit[own][:, None]
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > k)
        if len(many):
            high = score[many]
            least = np.partition(high, n_docs - k, axis=1)[:, n_docs - k]
            near[many] &= high >= (least - 2.0 * slack[own[many]]).astype(np.float32)[:, None]
        row, column = np.divmod(np.flatnonzero(near), n_docs)
        hand_on(own[row], column)
    return tuple(np.concatenate(x) for x in zip(*found))


def lists_of(table: pa.Table, name: str) -> dict[str, np.ndarray]:
    """Fields of a list of structs of all rows, and where each row's ``start``."""
    column = table.column(name).combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    flat = column.flatten()
    fields = {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}
    offsets = column.offsets.to_numpy()
    return {**fields, "start": (offsets - offsets[0]).astype(np.int64)}


def _best(index: TextIndex, blocks: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``number, index, score, matched`` of every block's top ``k``.

    ``weights``: number, term, idf and floor, of one part of the queries.
    """
    asked = weights.groupBy("term").agg(
        F.collect_list(F.struct("number", "idf", "floor")).alias("asked"))
    key = blocks.schema["entries"].dataType.elementType["index"].dataType.simpleString()
    avg_len = index.avg_len

    def best(table: pa.Table) -> pa.Table:
        return _best_of_block(table, k, avg_len)

    return (blocks.join(F.broadcast(asked), "term").groupBy("block")
            .applyInArrow(best, f"number long, index {key}, score double, matched int"))


def top_k(scored: DataFrame, k: int, *order: Column, by: str = "query_id",
          rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group with their rank from 1.

    Each task keeps k rows per group before the shuffle, so a group holding a
    third of all rows never meets in one task.
    """
    ordered = Window.partitionBy(by).orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(ordered)).where(F.col(rank) <= k)


def search(queries: DataFrame, index: TextIndex, k: int = 10, query: str = "query",
           sample_one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """BM25 top ``k`` per query: ``query_id, rank, index, score, matched``.

    Documents sharing any term are candidates; ties go to the lower key.  The k-th
    best score among some of the blocks is never above the k-th best among all, so
    where there are many blocks a few are searched first, and the others leave out
    what lies below that floor.
    """
    names, weights = query_terms(queries, index, query)
    n_terms = weights.count()
    if n_terms > BROADCAST_ROWS:
        return _search_in_place(names, weights, n_terms, index, k)
    blocks = index.blocks
    if 0 < n_terms <= NAMED_TERMS:
        blocks = _of_terms(blocks, sorted(
            {row["term"] for row in weights.select("term").collect()}))
    own = weights.withColumn("floor", F.lit(0.0))
    if index.n_blocks >= 2 * sample_one_in:
        some = _best(index, blocks.where(F.col("block") < index.n_blocks // sample_one_in),
                     own, k)
        floors = materialise(
            top_k(some, k, F.desc("score"), F.asc("index"), by="number")
            .where(F.col("rank") == k).select("number", F.col("score").alias("kth")), "floors")
        # a little lower, for sums in another order and the rounding of the score
        own = own.join(floors, "number", "left").withColumn(
            "floor", F.greatest(F.coalesce("kth", F.lit(0.0)) - 1e-5, F.lit(0.0)))
    best = _best(index, blocks, own, k)
    return top_k(best, k, F.desc("score"), F.asc("index"), by="number").join(
        names, "number").select("query_id", "rank", "index", "score", "matched")


def _search_in_place(names: DataFrame, weights: DataFrame, n_terms: int, index: TextIndex,
                     k: int) -> DataFrame:
    """``search`` where tasks hold the queries and read the blocks from their files.

    Neither queries nor partial results are copied: a task has the whole result of its
    queries.
    """
    cores = weights.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-n_terms // BROADCAST_ROWS), -(-names.count() * k // RESULTS),
                min(2 * cores, -(-64 * n_terms // BROADCAST_ROWS)))
    files, avg_len = index.blocks.inputFiles(), index.avg_len
    schema = T.StructType([
        names.schema["query_id"], T.StructField("rank", T.IntegerType()),
        index.docs.schema["index"], T.StructField("score", T.DoubleType()),
        T.StructField("matched", T.IntegerType())])
    most = BROADCAST_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= most:
                table = pa.concat_tables(held)
                number = table["number"].to_numpy()
                last = int(np.searchsorted(number, number[-1]))  # may have more rows
                yield from answered(table.slice(0, last))
                held = [table.slice(last)]
        if held:
            yield from answered(pa.concat_tables(held))

    def answered(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        _, first, query = np.unique(
            table["number"].to_numpy(), return_index=True, return_inverse=True)
        coded = table["term"].combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.unify_dictionaries().combine_chunks()
        code, terms = coded.indices.to_numpy(), coded.dictionary
        weight, best = table["idf"].to_numpy(), _Best(len(first), k)
        for entries, block_terms in _blocks_in(files, terms):
            row_of = np.full(len(terms), -1)
            row_of[block_terms] = np.arange(len(block_terms))
            row = row_of[code]
            here = row >= 0
            best.add(*_score(entries, query[here], row[here], weight[here], best.floor, k,
                             avg_len))
        asked = table["query_id"].take(pa.array(first))
        for rank, (row, ids, score, matched) in best.strips():
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays(asked.take(pa.array(row)).chunks),
                pa.array(rank, pa.int32()),
                pa.array(ids, from_pandas=True).cast(key), pa.array(score),
                pa.array(matched, pa.int32())], schema.names)

    key = _arrow_type(index.docs.schema["index"].dataType)
    # the rows of a query follow each other, terms that weigh least first
    return (weights.join(names, "number").select("number", "query_id", "term", "idf")
            .repartition(tasks, "number").sortWithinPartitions("number", "idf", "term")
            .mapInArrow(run, schema))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def _blocks_in(files: list[str], terms: pa.Array) -> Iterator[tuple[dict, np.ndarray]]:
    """For every block of ``files``, which are sorted by block, the lists of those of
    ``terms`` that it has, and the places of these in ``terms``."""
    for uri in files:
        system, path = fs.FileSystem.from_uri(uri)
        with system.open_input_file(path) as source:
            held: list[pa.RecordBatch] = []
            for batch in pq.ParquetFile(source).iter_batches(
                    1 << 14, columns=["block", "term", "entries"]):
                block = batch.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
                for low, high in zip(cuts[:-1], cuts[1:]):
                    if held and held[-1].column("block")[0].as_py() != block[low]:
                        yield _lists_for(held, terms)
                        held = []
                    held.append(batch.slice(low, high - low))
            if held:
                yield _lists_for(held, terms)


def _lists_for(block: list[pa.RecordBatch], terms: pa.Array) -> tuple[dict, np.ndarray]:
    table = pa.Table.from_batches(block)
    place = pc.index_in(table["term"], value_set=terms)
    table = table.append_column("place", place).filter(place.is_valid()).combine_chunks()
    return lists_of(table, "entries"), table["place"].to_numpy()


class _Best:
    """The best ``k`` of some queries among the blocks seen so far, and their floors."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.zeros(n)
        self.kept: tuple | None = None  # query, key, score, matched, in order
        self.added: list[tuple] = []
        self.waiting = 0

    def add(self, row: np.ndarray, *columns: np.ndarray) -> None:
        self.added.append((row, *columns))
        self.waiting += len(row)
        if self.waiting > (0 if self.kept is None else len(self.kept[0]) // 4):
            self.merge()

    def merge(self) -> None:
        tables = [*([] if self.kept is None else [self.kept]), *self.added]
        if tables:
            row, ids, score, matched = (np.concatenate(x) for x in zip(*tables))
            best = np.lexsort((ids, -score, row))
            best = best[np.arange(len(row)) - np.searchsorted(row[best], row[best]) < self.k]
            self.kept = row[best], ids[best], score[best], matched[best]
            row, _, score, _ = self.kept
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1)
            # a little lower, for sums in another order and the rounding of the score
            self.floor[row[last]] = np.maximum(score[last] - 1e-5, 0.0)
        self.added, self.waiting = [], 0

    def strips(self) -> Iterator[tuple[np.ndarray, tuple]]:
        """Ranks from 1, and the rows, some at a time."""
        self.merge()
        for at in range(0, 0 if self.kept is None else len(self.kept[0]), 1 << 16):
            row = self.kept[0]
            some = np.arange(at, min(at + (1 << 16), len(row)))
            yield some - np.searchsorted(row, row[some]) + 1, tuple(c[some] for c in self.kept)
