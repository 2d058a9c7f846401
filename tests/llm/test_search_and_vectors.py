"""Ranked search, whitening and the vector graph against plain versions, and rule choice."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import decontaminate, mixing, neardup, nra, rules, vector_graph, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WIDE = "doc_id long, text string, n long, term string, place string, score long, number string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    """docs, items: (id, text) -> item position: [(score, doc_id)], best first."""
    counted = [(d, terms_of(t)) for d, t in docs]
    n_docs, total = sum(bool(t) for _, t in counted), sum(len(t) for _, t in counted)
    df = Counter(x for _, t in counted for x in set(t))
    out = {}
    for i, (_, text) in enumerate(items):
        found = []
        for d, own in counted:
            tf = Counter(own)
            m = 100 - 50 + (50 * len(own) * n_docs) // total if total else 0
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m))
                for x in set(terms_of(text)) if tf[x])
            if score > 0:
                found.append((score, d))
        out[i] = sorted(found, key=lambda e: (-e[0], e[1] is None, e[1]))[:k]
    return out


def texts(rng, n):
    made = [None, "", " .,;", "A", "a", "a-a_a", "Ä ß x y", "z " * 20_000, "don't 12,5", "\x00"]
    made += [" ".join(f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(1, 80)))
             for _ in range(n)]
    made += made[20:40]  # copies tie
    return made


@pytest.mark.parametrize("k, at_once, block, read", [(5, 1 << 20, 1 << 14, 64), (50, 30, 7, 1)])
def test_ranked_search_equals_full_scoring(spark, monkeypatch, k, at_once, block, read):
    monkeypatch.setattr(nra, "BLOCK_DOCS", block)
    monkeypatch.setattr(nra, "FIRST_READ", read)
    rng = random.Random(5)
    docs = [(i % 140 or None, t) for i, t in enumerate(texts(rng, 150))]  # repeated and null ids
    items = [(i, t) for i, t in enumerate(texts(rng, 12))] + [(None, "w1 w2"), (3, "w5 A")]
    given = spark.createDataFrame([(*d, 1, "x", "x", 0, "x") for d in docs], WIDE)
    asked = spark.createDataFrame([(*d, 0) for d in items], "item_id long, text string, rank int")
    found = nra.rank_documents(given, asked, k, at_once).collect()
    want = ranked(docs, items, k)
    got = Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found)
    assert got == Counter((items[i][0], n + 1, d, s) for i, own in want.items()
                          for n, (s, d) in enumerate(own))


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert nra.rank_documents(docs, items.where("false")).count() == 0
    assert nra.rank_documents(docs.where("false"), items).count() == 0
    assert nra.rank_documents(docs, items.withColumn("text", F.lit("q"))).count() == 0


def test_sorted_reads_stop_early_and_settle_ties():
    rng = np.random.default_rng(2)
    n = 50_000
    lists = []
    for _ in range(3):
        gains = np.sort((rng.pareto(1.2, n) * 1000).astype(np.int64) + 1)[::-1]
        lists.append((rng.permutation(n), gains))
    full = np.zeros(n, np.int64)
    for docs, gains in lists:
        full[docs] += gains
    low = np.sort(full)[-10]
    docs, scores, read = nra.sorted_reads(lists, n, 10, 0)
    assert set(docs) == set(np.flatnonzero(full >= low)) and (scores == full[docs]).all()
    ties = [(np.arange(n), np.full(n, 7))]
    assert len(nra.sorted_reads(ties, n, 10, 0)[0]) == n
    # a list that ends early leaves nothing to read for the last documents
    short = [(np.arange(500), np.arange(500, 0, -1)), (np.arange(100), np.full(100, 10_000))]
    docs, scores, read = nra.sorted_reads(short, 500, 10, 0)
    assert docs.tolist() == list(range(10)) and read < 600


# Whitening

def vectors_table():
    rng = np.random.default_rng(4)
    mixed = rng.normal(size=(300, 20)) @ rng.normal(size=(20, 20))
    rows = [(i, v.tolist()) for i, v in enumerate(mixed)]
    rows += [(500 + i, mixed[0].tolist()) for i in range(60)]  # copies count once in the fit
    rows += [(1, mixed[1].tolist()), (None, mixed[2].tolist())]
    bad = [(900, None), (901, [None] * 20), (902, [float("nan")] * 20), (903, [float("inf")] * 20),
           (904, [1.0]), (905, []), (906, [1e30] * 20)]
    return rows, bad


EMBEDDED = "vec_id long, embedding array<double>, index long, x string, centred int, at int"


def embedded(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], EMBEDDED)


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 20 * 32)  # ten blocks of rows
    rows, bad = vectors_table()
    found = whitening.whiten(embedded(spark, rows + bad)).toPandas()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = (n * fit - sums) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:16]
    assert len(found) == 16 * len(rows) and set(found["n"]) == {n} == {300}
    share = found.drop_duplicates("component").sort_values("component")["explained"].to_numpy()
    assert share == pytest.approx(values[order] / values.sum(), rel=1e-9)
    want = ((n * x - sums) / n) @ (axes[:, order] / np.sqrt(values[order]))
    deviation = ((n * x - sums).astype(object) ** 2).sum(axis=1)
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is None or vec_id == 1:
            continue
        own = found[found["vec_id"] == vec_id].sort_values("component")
        assert np.abs(own["whitened"].to_numpy()) == pytest.approx(np.abs(want[i]), abs=1e-8)
        assert set(own["deviation"]) == {deviation[i]}
    fitted = found.drop_duplicates(["vec_id", "component"]).pivot(
        index="vec_id", columns="component", values="whitened").loc[range(300)].to_numpy()
    assert np.abs(fitted.T @ fitted / 300 - np.eye(16)).max() < 1e-8
    assert found["identity_error"].max() < 1e-8


def test_whitening_without_directions(spark):
    flat = [(1, [1.0, 2.0]), (2, [1.0, 2.0])]
    for rows in ([], flat, [(1, None)], [(1, [])]):
        assert whitening.whiten(embedded(spark, rows)).count() == 0
    line = [(i, [float(i), 5.0, -2.0 * i]) for i in range(40)]
    found = whitening.whiten(embedded(spark, line)).toPandas()
    assert len(found) == 40 and set(found["component"]) == {1}
    assert found["explained"].iloc[0] == pytest.approx(1.0)


def test_rows_are_numbered_without_gaps(spark):
    rows = spark.range(1000).repartition(7).withColumnRenamed("id", "key")
    found = whitening.number_rows(rows, "numbers").toPandas()
    assert sorted(found["index"]) == list(range(1000)) and set(found["key"]) == set(range(1000))


# Vector graph

def plain_links(rows):
    """rows: (vec_id, unit vector or None) -> links and least reachable id per row."""
    ok = [i for i, (_, v) in enumerate(rows) if v is not None]
    unit = np.array([rows[i][1] for i in ok])
    near = unit @ unit.T >= 0.95
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in np.argwhere(near).tolist():
        parent[root(ok[a])] = root(ok[b])
    least = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    links = dict.fromkeys(range(len(rows)), 0) | dict(zip(ok, near.sum(axis=1) - 1))
    return [(d, int(links[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("block, shard", [(4096, 1024), (60, 40)])
def test_vector_graph_equals_all_pairs(spark, monkeypatch, block, shard):
    monkeypatch.setattr(vector_graph, "BLOCK_ROWS", block)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(250, 32))
    rows = [(3 * i + 1, v) for i, v in enumerate(base)]
    hot = base[0] / np.linalg.norm(base[0])
    rows += [(2000 + i, hot + rng.normal(size=32) * rng.uniform(0.01, 0.06)) for i in range(90)]
    rows += [(3000 + i, 5 * base[1]) for i in range(40)]       # copies of one direction
    chain = [base[2]]
    for i in range(30):                                        # a drifting chain
        step = chain[-1] + rng.normal(size=32) * 0.2
        chain.append(step)
        rows.append((4000 + i, step))
    rows += [(1, base[3]), (None, base[4])]                    # repeated and null ids
    sent = [(d, v.tolist()) for d, v in rows]
    bad = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0]),
           (9004, [None] * 32), (9005, [1e300] * 32), (9006, [1e300] * 32)]
    unit = [(d, v / np.linalg.norm(v)) for d, v in rows]
    unit += [(d, np.ones(32) / np.sqrt(32) if d >= 9005 else None) for d, _ in bad]
    found = vector_graph.near_vectors(embedded(spark, sent + bad), shard_rows=shard,
                                      recall=1.0).collect()
    assert Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == Counter(
        plain_links(unit))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert all(r["audit_recall"] >= 0.99 for r in found)


def test_vector_graph_of_few_vectors(spark):
    assert vector_graph.near_vectors(embedded(spark, [])).count() == 0
    for rows in ([(5, None)], [(5, [1.0, 0.0])], [(5, [0.0, 0.0])]):
        found = vector_graph.near_vectors(embedded(spark, rows)).first()
        assert (found["n_links"], found["component_id"], found["kept"]) == (0, 5, True)
    found = vector_graph.near_vectors(embedded(spark, [(5, [1.0, 0.0]), (4, [1.0, 0.1])])).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(5, 1, 4), (4, 1, 4)}


def test_robust_pruning_keeps_the_nearest_and_drops_the_shadowed():
    angles = np.array([0.0, 0.1, 0.12, 0.3, -0.5])
    rows = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    chosen, cosine = vector_graph.nearest(rows[:1], rows, 4, np.array([0]))
    kept = vector_graph.robust_prune(rows, chosen, cosine)
    assert chosen[0][kept[0]].tolist() == [1, 4]


def test_graph_search_finds_what_is_in_range():
    rng = np.random.default_rng(9)
    rows = vector_graph.unit(rng.normal(size=(1500, 48)))
    rows[700:760] = vector_graph.unit(rows[0] + rng.normal(size=(60, 48)) * 0.02)
    tail, head = vector_graph.flat_graph(rows)
    edges = np.full((1500, 2 * vector_graph.DEGREE), -1)
    for node in range(1500):
        own = head[tail == node]
        edges[node, :len(own)] = own
    # queries that are no nodes: from the medoids alone
    who, row = vector_graph.range_search(
        rows, edges, vector_graph.medoids(rows), rows[700:760], np.full(60, -1))
    true = int((rows[700:760] @ rows.T >= 0.95).sum())
    assert len(who) >= 0.9 * true


# Rules

def plain_choice(good, path, limit, error):
    """The tightest step that passes in sequence; good: (stratum, ratios by rule)."""
    chosen = {}
    for where in rules.STRATA:
        own = [ratios for s, ratios in good if s == where]
        for step in range(len(rules.STEPS)):
            wrong = sum(any(v > path[where, r][step] for r, v in ratios.items()) for ratios in own)
            tail = sum(math.comb(len(own), i) * limit**i * (1 - limit)**(len(own) - i)
                       for i in range(wrong + 1))
            if not own or tail > error / 2:
                break
            chosen[where] = step
    return chosen


def test_steps_equal_a_plain_sequence(spark):
    rng = random.Random(8)
    path = {(s, r): [5.0 * t for t in rules.STEPS] for s in rules.STRATA for r in rules.RULES}
    rows, good = [], []
    for i in range(900):
        n = rng.choice([100, 300])
        marks = rng.choice([0] * 30 + [1, 2, 5, 10, 40])
        rows.append((i, n, 5 * n, marks, 0, 0, 10, 0, 0, i))
        good.append(("short" if n < 200 else "long", {"symbols": 100 * marks / n}))
    rows += [(0, 100, 500, 99, 0, 0, 10, 0, 0, 0)]            # a repeated id is one trial
    rows += [(5000 + i, 100, 500, 0, 0, 0, 10, 0, 0, 1) for i in range(500)]  # copies are one
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in (*rules.STATS, "sketch"))
    table = spark.createDataFrame(rows, schema)
    found = rules.choose_steps(table, path, 0.02, 0.05)
    assert found == plain_choice(good, path, 0.02, 0.05) and found


@pytest.mark.parametrize("k, n, p", [(0, 183, 0.02), (3, 500, 0.02), (40, 1000, 0.05), (7, 9, 0.9),
                                     (19, 20, 0.99), (250, 10_000, 0.02)])
def test_binomial_tail(k, n, p):
    want = math.fsum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)) if (
        n <= 1000) else None
    if want is not None:
        assert rules.at_most(k, n, p) == pytest.approx(want, rel=1e-9)
    assert 0 <= rules.at_most(k, n, p) <= 1


# Stages over columns with clashing names

def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(11)

    def prose(n):
        return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))

    item, copied = prose(40), prose(90)
    rows = [(i, prose(80), "s", 80) for i in range(30)]
    rows += [(40, copied, "s", 1), (41, copied, "s", 2), (None, f"{prose(9)} {item}", "s", 3),
             (7, f"{item} {prose(9)}", "s", 4), (None, None, None, None)]
    names = ["_text", "_kept", "_leak", "_row", "_mark", "_size", "_taken", "_epoch", "key"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for name in names:
        docs = docs.withColumn(name, F.lit(name))
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    one = neardup.keep_one(docs)
    clean = decontaminate.drop_leaks(docs, benchmark)
    mixed = mixing.mix(docs)
    for out in (one, clean, mixed):
        assert out.columns == docs.columns
        assert all(r[name] == name for r in out.select(*names).collect() for name in names)
    assert 41 not in {r["doc_id"] for r in one.collect()}
    left = clean.collect()
    assert all(item not in (r["text"] or "") for r in left)
    assert len(left) == len(rows) - 2 and any(r["doc_id"] == 7 for r in left)
