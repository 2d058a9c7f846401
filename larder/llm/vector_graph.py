"""Near-duplicate vectors by search in a robust-pruned flat graph.

Equal vectors are one node.  Every node goes to the shards of its nearest pivots, so
shards overlap, and shards are cut into blocks of bounded size.  A block builds a
graph: a node keeps its nearest candidates except those that a kept one is much
closer to (robust pruning, Subramanya et al. 2019), and the edges are turned round as
well.  The adjacency lists of a node from all its blocks are united.  Every node then
searches the blocks of its shards: greedily from the medoids and its own place towards
itself, and from there on through all that lies in range or a little beyond, until
nothing new is in range.  Cosines are computed in double precision, so a link that is
found is one.  A task hands on the least node of every connected part of the links,
never the pairs: a group of near-equal vectors costs rows in proportion to its size.

What the links connect is then verified: all nodes of a component are compared with
each other, in blocks, which counts every node's links in double precision, also
those to nodes of its component with which it shares no shard.  A sample of nodes is
compared with all others; as long as the recall of links is below the target, the
shards overlap more, up to the point where every shard holds every node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.operators.skew import join_unique
from larder.session import materialise

COSINE = 0.95
OVERLAP = 3          # shards of a node at first
SHARD_ROWS = 1_024   # nodes of a shard on average, counted once
MAX_PIVOTS = 4_096
BLOCK_ROWS = 4_096   # nodes, and queries, of a task's graph
CANDIDATES = 48      # nearest nodes from which a node's edges are chosen
DEGREE = 24          # edges of a node in one block, and as many turned ones
ALPHA = 1.2
BEAM = 12
SLACK = 0.05         # of cosine, below the limit, that the expansion passes through
MEDOIDS = 16
STRIP = 128          # queries walked at a time
AUDIT = 256          # nodes compared with all others, and as many that have links
RECALL = 0.99


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of doubles of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """``values`` by their sorted ``owner``, one list each."""
    starts = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(starts), pa.array(values))


def nearest(rows: np.ndarray, others: np.ndarray, k: int, but: np.ndarray | None = None
            ) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` of ``others`` with the greatest cosine to each row, and it, falling."""
    cosine = rows @ others.T
    if but is not None:
        cosine[np.arange(len(rows)), but] = -2
    best = np.argpartition(-cosine, min(k, cosine.shape[1]) - 1, axis=1)[:, :k]
    order = np.argsort(-np.take_along_axis(cosine, best, 1), axis=1, kind="stable")
    best = np.take_along_axis(best, order, 1)
    return best, np.take_along_axis(cosine, best, 1)


def robust_prune(rows: np.ndarray, chosen: np.ndarray, cosine: np.ndarray, degree: int = DEGREE
                 ) -> np.ndarray:
    """Which of the candidates ``chosen`` (rows x k, nearest first) stay as edges.

    A candidate goes when a kept one is ``ALPHA`` times closer to it than the row is.
    """
    points = rows[chosen]
    apart = np.sqrt(np.maximum(2 - 2 * np.einsum("sid,sjd->sij", points, points), 0))
    own = np.sqrt(np.maximum(2 - 2 * cosine, 0))
    left = cosine > -2
    kept = np.zeros(chosen.shape, bool)
    for i in range(chosen.shape[1]):
        kept[:, i] = left[:, i] & (kept.sum(axis=1) < degree)
        left &= ~(kept[:, i, None] & (ALPHA * apart[:, i] <= own))
    return kept


def flat_graph(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the edges of a block of unit vectors, both ways round, sorted."""
    n, k = len(rows), min(CANDIDATES, len(rows) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tails, heads, weights = [], [], []
    for at in range(0, n, 256):
        own = np.arange(at, min(at + 256, n))
        chosen, cosine = nearest(rows[own], rows, k, own)
        row, place = np.nonzero(robust_prune(rows, chosen, cosine))
        tails.append(own[row])
        heads.append(chosen[row, place])
        weights.append(cosine[row, place])
    tail, head, weight = map(np.concatenate, (tails, heads, weights))
    # of the edges that end in a node the nearest are turned round
    order = np.lexsort((-weight, head))
    turn = np.arange(len(order)) - np.searchsorted(head[order], head[order]) < DEGREE
    back = order[turn]
    edges = np.unique(np.concatenate([tail * n + head, head[back] * n + tail[back]]))
    return edges // n, edges % n


def medoids(rows: np.ndarray) -> np.ndarray:
    """The middle of the block and of its parts about evenly dealt rows."""
    parts = rows @ rows[::max(1, len(rows) // MEDOIDS)].T
    cell = parts.argmax(axis=1)
    found = [int((rows @ rows.mean(axis=0)).argmax())]
    for part in np.unique(cell):
        own = np.flatnonzero(cell == part)
        found.append(int(own[(rows[own] @ rows[own].mean(axis=0)).argmax()]))
    return np.unique(found)


def range_search(rows: np.ndarray, edges: np.ndarray, first: np.ndarray, queries: np.ndarray,
                 own: np.ndarray, least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with a cosine of at least ``least`` that the walk meets.

    ``edges`` (rows x degree, -1 for none), ``first`` the rows to start from, ``own``
    the row that is the query itself, or -1.
    """
    n, q = len(rows), len(queries)
    seen = np.full((q, n), -2.0)
    done = np.zeros((q, n), bool)

    def visit(query: np.ndarray, row: np.ndarray) -> None:
        new = seen[query, row] == -2
        cells = np.unique(query[new] * n + row[new])
        query, row = cells // n, cells % n
        for at in range(0, len(query), 1 << 16):
            some = slice(at, at + (1 << 16))
            seen[query[some], row[some]] = np.einsum(
                "ij,ij->i", queries[query[some]], rows[row[some]])

    visit(np.repeat(np.arange(q), len(first)), np.tile(first, q))
    known = np.flatnonzero(own >= 0)
    visit(known, own[known])
    while True:
        bound = np.partition(seen, max(n - BEAM, 0), axis=1)[:, max(n - BEAM, 0)]
        near = (seen >= np.minimum(bound, least - SLACK)[:, None]) & (seen > -2) & ~done
        query, row = np.nonzero(near)
        if not len(query):
            break
        done[query, row] = True
        ends = edges[row]
        some = ends >= 0
        visit(np.repeat(query, some.sum(axis=1)), ends[some])
    return np.nonzero(seen >= least)


def _shards(nodes: DataFrame, pivots: np.ndarray, overlap: int) -> DataFrame:
    """``shard, node, vec``: every node once for each of its nearest pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            best, _ = nearest(unit(_matrix(batch.column("vec"))), pivots, overlap)
            every = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(best.ravel().astype(np.int32)),
                **{c: batch.column(c).take(every) for c in ("node", "vec")}})

    return nodes.select("node", "vec").mapInArrow(
        run, "shard int, node long, vec array<double>")


def _build(table: pa.Table) -> pa.Table:
    tail, head = flat_graph(unit(_matrix(table.column("vec"))))
    node = table.column("node").to_numpy()
    return pa.table({"node": table.column("node"), "near": _lists(node[head], tail, len(node))})


def _halves(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """The rows that are asked, and those that ask."""
    asks = table.column("asks")
    return (table.filter(pc.invert(asks)).combine_chunks(), table.filter(asks).combine_chunks())


def _search(table: pa.Table) -> pa.Table:
    """``a, b``: every linked node, or least node of some, with the least that it reaches."""
    base, query = _halves(table)
    node, asked = base.column("node").to_numpy(), query.column("node").to_numpy()
    rows, theirs = unit(_matrix(base.column("vec"))), unit(_matrix(query.column("vec")))
    order = np.argsort(node)

    def place(ids: np.ndarray) -> np.ndarray:
        at = order[np.minimum(np.searchsorted(node, ids, sorter=order), len(node) - 1)]
        return np.where(node[at] == ids, at, -1)

    near = base.column("near").combine_chunks()
    ends, sizes = place(near.flatten().to_numpy()), np.diff(near.offsets.to_numpy())
    edges = np.full((len(node), max(1, int(sizes.max()))), -1)
    edges[np.repeat(np.arange(len(node)), sizes),
          np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = ends
    first, own, least = medoids(rows), place(asked), node.copy()
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(asked), STRIP):
        some = asked[at:at + STRIP]
        who, row = range_search(rows, edges, first, theirs[at:at + STRIP], own[at:at + STRIP])
        reached, old = some.copy(), least.copy()
        while True:
            before = reached.copy()
            np.minimum.at(reached, who, least[row])
            np.minimum.at(least, row, reached[who])
            if (reached == before).all():
                break
        moved = least != old
        found += [np.stack([some, reached]), np.unique(np.stack([old[moved], least[moved]]), axis=1)]
    a, b = np.concatenate(found, axis=1)
    return pa.table({"a": a[a != b], "b": b[a != b]})


def _blocks(sizes: dict[int, int], n: int) -> Column:
    """Blocks of the shard by its number of nodes."""
    return F.element_at(F.lit([-(-sizes.get(s, 1) // BLOCK_ROWS) for s in range(n)]),
                        F.col("shard") + 1)


def _met(members: DataFrame, key: str, blocks: Column, *columns: str) -> DataFrame:
    """Every block of a group of ``members`` as asking rows with every block as asked ones."""
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    asked = members.select(key, "block", every.alias("lane"), "node", "vec", *columns,
                           F.lit(False).alias("asks"))
    asking = members.select(key, every.alias("other"), "block", "node", "vec", *(
        F.lit(None).cast(members.schema[c].dataType).alias(c) for c in columns),
        F.lit(True).alias("asks"))
    return asked.union(asking)


def graph_links(nodes: DataFrame, pivots: np.ndarray, overlap: int) -> DataFrame:
    """``a, b``: edges that connect what the links of ``nodes`` (node, vec) connect."""
    sharded = materialise(_shards(nodes, pivots, overlap), "shards")
    sizes = {r["shard"]: r["count"] for r in sharded.groupBy("shard").count().collect()}
    blocks = _blocks(sizes, len(pivots))  # one number per pivot
    members = sharded.withColumn(
        "block", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"))
    built = members.select("shard", "block", "node", "vec").groupBy("shard", "block").applyInArrow(
        _build, "node long, near array<long>")
    # a node has at most DEGREE edges and as many turned ones from each of its blocks
    united = materialise(built.groupBy("node").agg(
        F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    met = _met(members.join(united, "node"), "shard", blocks, "near")
    return materialise(met.groupBy("shard", "block", "lane").applyInArrow(
        _search, "a long, b long"), "vector-edges")


def _count(table: pa.Table) -> pa.Table:
    base, query = _halves(table)
    node, m = base.column("node").to_numpy(), base.column("m").to_numpy()
    asked = query.column("node").to_numpy()
    rows, theirs = unit(_matrix(base.column("vec"))), unit(_matrix(query.column("vec")))
    links = np.zeros(len(asked), np.int64)
    for at in range(0, len(asked), STRIP):
        some = slice(at, at + STRIP)
        near = (theirs[some] @ rows.T >= COSINE) & (node[None, :] != asked[some][:, None])
        links[some] = near @ m
    return pa.table({"node": asked, "links": links})


def count_links(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    """``node, links``: links, with repeats, among ``nodes`` (node, m, vec) of a component.

    ``joined``: id, component.
    """
    members = nodes.join(joined.withColumnRenamed("id", "node"), "node")
    sizes = materialise(joined.groupBy("component").agg(F.count(F.lit(1)).alias("n")),
                        "component-sizes")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    members = join_unique(members, sizes, "component", counts=sizes).withColumn("blocks", blocks)
    members = members.withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    met = _met(members, "component", F.col("blocks"), "m")
    return materialise(
        met.groupBy("component", "block", "lane").applyInArrow(_count, "node long, links long")
        .groupBy("node").agg(F.sum("links").alias("links")), "link-counts")


def compare_all(nodes: DataFrame, sample: list, least: float = COSINE) -> dict[int, int]:
    """Links of the ``sample`` (node, vec), at most two times ``AUDIT``, by comparing all."""
    ids = np.array([r["node"] for r in sample], np.int64)
    asked = unit(np.array([r["vec"] for r in sample], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = unit(_matrix(batch.column("vec"))) @ asked.T >= least
                near &= batch.column("node").to_numpy()[:, None] != ids[None, :]
                links += batch.column("m").to_numpy() @ near
        yield pa.RecordBatch.from_pydict({"node": pa.array(ids), "links": pa.array(links)})

    return {r["node"]: r["links"] for r in nodes.select("node", "m", "vec").mapInArrow(
        run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links")).collect()}


def audit(nodes: DataFrame, counts: DataFrame) -> float:
    """Share of the links of sampled nodes that ``counts`` (node, links) has."""
    order = F.xxhash64(F.lit(12), "node")
    rows = nodes.select("node", "vec")
    drawn = {r["node"]: r for r in [
        *rows.orderBy(order).limit(AUDIT).collect(),
        *rows.join(counts.where("links > 0").orderBy(order).limit(AUDIT).select("node"), "node")
        .collect()]}
    true = compare_all(nodes, list(drawn.values()))
    ids = nodes.sparkSession.createDataFrame([(n,) for n in drawn], "node long")
    found = {r["node"]: r["links"] for r in counts.join(F.broadcast(ids), "node").collect()}
    total = sum(true.values())
    return sum(min(found.get(n, 0), t) for n, t in true.items()) / total if total else 1.0


def near_vectors(vectors: DataFrame, recall: float = RECALL, shard_rows: int = SHARD_ROWS,
                 overlap: int = OVERLAP) -> DataFrame:
    """Links of ``vectors`` (vec_id, embedding) with a cosine of at least ``COSINE``.

    Returns per row: vec_id, n_links (rows linked directly), component_id (least vec_id
    reachable, the own included), kept (vec_id = component_id) and audit_recall, the
    recall of links of the audited sample.

    A vector that is null, zero, holds a null or non-finite component, or has not the
    most common length (of equally common ones the longest) links with nothing; its
    component is its own id.  Repeated rows link with each other, and rows of one id
    with unlike vectors are vectors of their own.  A row with a null id is linked like
    others but is no component's least id; where no id is reachable, component_id is null
    and kept true.  An empty table gives an empty result.  Other columns are not read.
    """
    rows = materialise(vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("vec")), "vectors")
    fine = rows.where(F.col("vec").isNotNull() & F.exists("vec", lambda c: c != 0) & F.forall(
        "vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    length = (fine.groupBy(F.size("vec").alias("dim")).count()
              .orderBy(F.desc("count"), F.desc("dim")).first())
    fine = fine.where(F.size("vec") == (length["dim"] if length else 0))
    nodes = materialise(fine.groupBy("vec").agg(
        F.min("row").alias("node"), F.min("vec_id").alias("least_id"),
        F.count(F.lit(1)).alias("m")), "nodes")
    n = nodes.count()
    reach, linked = 1.0, None
    if n > 1:
        drawn = nodes.orderBy(F.xxhash64(F.lit(7), "node")).limit(
            min(MAX_PIVOTS, -(-n // shard_rows))).select("vec").collect()
        pivots = unit(np.array([r["vec"] for r in drawn], float))
        overlap = min(overlap, len(pivots))
        while True:
            linked = components(graph_links(nodes, pivots, overlap), "vector-links")
            counts = count_links(nodes, linked)
            reach = audit(nodes, counts)
            if reach >= recall or overlap == len(pivots):
                break
            overlap = min(2 * overlap, len(pivots))
    if linked is None:
        described = nodes.select("vec", "m", (F.col("m") - 1).alias("n_links"),
                                 F.col("least_id").alias("component_id"))
    else:
        described = (
            nodes.join(counts, "node", "left")
            .join(linked.withColumnRenamed("id", "node"), "node", "left")
            .select("vec", "m", "least_id", F.coalesce("component", "node").alias("component"),
                    (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")))
        least = described.groupBy("component").agg(F.min("least_id").alias("component_id"))
        described = join_unique(described, materialise(least, "least-ids"), "component")
    described = materialise(described.select("vec", "m", "n_links", "component_id"), "described")
    joined = join_unique(fine, described.drop("m"), "vec",
                         counts=described.select("vec", F.col("m").alias("n")))
    alone = rows.join(joined.select("row"), "row", "left_anti").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.select("vec_id", "n_links", "component_id").unionByName(alone).select(
        "vec_id", "n_links", "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.lit(reach).alias("audit_recall"))
