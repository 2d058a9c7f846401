import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import vectors as vf
from larder.operators import approximate as ap
from larder.operators import fulltext as ft
from larder.operators import neighbours as nb
from larder.operators.embed import embed_texts, hashed_vectors
from larder.operators.hybrid import fuse
from larder.operators.skew import join_unique

TEXTS = {
    1: "Tomato soup with basil and tomato paste",
    2: "Chicken soup",
    3: "the the the the",
    4: "",
    5: "Basil pesto pasta, the classic",
    6: "Chicken curry with the rice",
}


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "index long, text string")
    return ft.build_index(docs, buckets=4)


def brute_force(query, k):
    docs = {i: t.lower().replace(",", "").split() for i, t in TEXTS.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for words in docs.values() for t in set(words))
    scores = defaultdict(float)
    for term in set(query.lower().split()) & set(df):
        idf = math.log(1 + (len(docs) - df[term] + 0.5) / (df[term] + 0.5))
        for i, words in docs.items():
            tf = words.count(term)
            if tf:
                scores[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
    ranked = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
    return [(i, -s) for s, i in ranked]


def test_index(index):
    assert index.n_docs == 6
    assert dict(index.term_df.collect())["basil"] == 2
    counts = {r["index"]: (r.doc_len, {t.term: t.tf for t in r.terms}) for r in index.docs.collect()}
    assert counts[4] == (0, {})
    assert counts[3] == (4, {"the": 4})
    assert counts[1][1]["tomato"] == 2


@pytest.mark.parametrize("per_block, one_in, rows, cells", [
    (1024, 16, ft.BROADCAST_ROWS, ft.CELLS), (1, 2, ft.BROADCAST_ROWS, 1), (2, 1, 3, 4)])
def test_search_equals_brute_force(spark, index, monkeypatch, per_block, one_in, rows, cells):
    monkeypatch.setattr(ft, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(ft, "CELLS", cells)
    docs = spark.createDataFrame(list(TEXTS.items()), "index long, text string")
    index = ft.build_index(docs, buckets=4, block_docs=per_block)
    assert index.n_blocks == -(-6 // per_block)
    asked = {"a": "tomato basil soup soup", "b": "the chicken", "c": "unknown words", "d": "the"}
    queries = spark.createDataFrame(list(asked.items()), "query_id string, query string")
    found = defaultdict(list)
    for row in ft.search(queries, index, 2, sample_one_in=one_in).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row["index"], row.score))
    for name, query in asked.items():
        want = brute_force(query, 2)
        assert [i for i, _ in found[name]] == [i for i, _ in want]
        assert [s for _, s in found[name]] == pytest.approx([s for _, s in want], abs=1e-6)


def test_shared_terms_are_summed_by_a_product(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(2)
    n, terms, asking = 200, 12, 60
    lists = [[{"index": int(i), "tf": int(rng.integers(1, 4)), "doc_len": 10 + int(i) % 7}
              for i in rng.choice(n, n // (t + 1), replace=False)] for t in range(terms)]
    asked = [[{"number": q, "idf": 1.0 + t, "floor": 2.0 * (q % 3)}
              for q in range(asking) if t == q % terms or rng.random() < 0.5] for t in range(terms)]
    table = pa.table({"entries": lists, "asked": asked})
    tables, spent = [], []
    bincount = np.bincount
    for product in (0, ft.PRODUCT):  # by lists alone, and with the product
        cells = []
        monkeypatch.setattr(ft, "PRODUCT", product)
        monkeypatch.setattr(np, "bincount", lambda x, *a, **b: (
            cells.append(len(x)) if b.get("minlength") else None, bincount(x, *a, **b))[1])
        tables.append(ft._best_of_block(table, 5, 12.0).to_pydict())
        monkeypatch.setattr(np, "bincount", bincount)
        spent.append(sum(cells))
    assert tables[0] == tables[1] and len(tables[0]["index"]) > asking
    assert spent[1] < spent[0] / 4


def test_search_plan_moves_only_top_rows(spark, index, capsys):
    queries = spark.createDataFrame([(1, "the soup")], "query_id long, query string")
    ft.search(queries, index, 3).explain()
    plan = capsys.readouterr().out
    assert "PushedFilters: [Or(EqualTo" in plan or "PushedFilters: [In(term" in plan
    assert "WindowGroupLimit" in plan and "Bucketed: true" in plan
    # of the best rows, and of the query terms before their broadcast
    assert plan.count("Exchange hashpartitioning") == 2


def rows(spark, matrix):
    return spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(matrix)],
        "index long, vec array<float>")


@pytest.mark.parametrize("metric", nb.METRICS)
@pytest.mark.parametrize("block_bytes, sample", [
    (nb.BLOCK_BYTES, nb.SAMPLE_ROWS), (4 * 6 * 40, 20), (4 * 6 * 40, 3)])
def test_knn_equals_brute_force(spark, monkeypatch, metric, block_bytes, sample):
    monkeypatch.setattr(nb, "SAMPLE_ROWS", sample)
    monkeypatch.setattr(nb, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    # a third of all vectors are copies of one
    data = np.vstack([np.repeat(rng.normal(size=(1, 6)), 100, axis=0),
                      rng.normal(size=(200, 6)) * rng.uniform(0.5, 3, size=(200, 1))])
    data = data.astype(np.float32)
    vectors = rows(spark, data)
    index = nb.build_vector_index(vectors, metric, block_bytes=block_bytes)
    queries = vectors.withColumnRenamed("index", "query_id")
    found = defaultdict(list)
    for row in nb.knn(queries, index, 7).orderBy("query_id", "rank").collect():
        found[row.query_id].append((row["index"], row.distance))
    wide = data.astype(np.float64)
    for q, ours in found.items():
        if metric == "l2":
            d = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        elif metric == "cosine":
            d = 1 - wide @ wide[q] / np.linalg.norm(wide, axis=1) / np.linalg.norm(wide[q])
        else:
            d = -(wide @ wide[q])
        want = sorted(zip(np.floor(d * 1e6 + 0.5) / 1e6, range(len(d))))[:7]
        assert [i for i, _ in ours] == [i for _, i in want]
        assert [x for _, x in ours] == pytest.approx([x for x, _ in want], abs=2e-6)
    assert len(found) == 300


def test_queries_skip_the_ranges_beyond_their_bound(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 500)
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(2000, 3)) * rng.uniform(0.1, 20, size=(2000, 1))).astype(np.float32)
    index = nb.build_vector_index(rows(spark, data), "l2", block_bytes=4 * 3 * 25)
    queries = rows(spark, data[:100]).withColumnRenamed("index", "query_id")
    visits = nb.visits_of(queries, index, 5).groupBy("query_id").count().toPandas()["count"]
    n_blocks = index.blocks.sum()
    assert n_blocks > 60 and visits.mean() < n_blocks / 3
    sizes = index.members.groupBy("slot", "block").count().toPandas()["count"]
    assert len(sizes) == n_blocks and sizes.max() < 3 * 25


def test_bundles_bound_what_is_sent(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 20)
    monkeypatch.setattr(nb, "LANE_ROWS", 64)
    rng = np.random.default_rng(11)
    data = np.vstack([rng.normal(size=(1500, 24)), np.zeros((1, 24))]).astype(np.float32)
    index = nb.build_vector_index(rows(spark, data), "dot", block_bytes=4 * 24 * 400)
    queries = rows(spark, data).withColumnRenamed("index", "query_id")
    # a query is sent once per bundle, not once per cell
    sent = nb.visits_of(queries, index, 5).count()
    assert len(index.slot_of) > 50 and sent <= 6 * len(data)
    assert index.members.groupBy("bundle").count().agg(F.max("count")).first()[0] <= 400
    found = nb.knn(queries, index, 5).where("query_id = 1500").orderBy("rank").collect()
    assert [r["index"] for r in found] == [0, 1, 2, 3, 4]  # equal ones, over all cells


def test_approximate_search_hands_on_only_its_best(spark, capsys):
    rng = np.random.default_rng(12)
    data = rng.normal(size=(600, 16)).astype(np.float32)
    index = ap.build_approximate(rows(spark, data), "l2")
    queries = rows(spark, data).withColumnRenamed("index", "query_id")
    ap.approximate_knn(queries, index, 5).explain()
    plan = capsys.readouterr().out
    # candidates meet their vectors in the task: no join after the cogroup
    assert "Join" not in plan[:plan.index("FlatMapCoGroupsInPandas")]


@pytest.mark.parametrize("metric", nb.METRICS)
def test_approximate_search_reaches_its_recall(spark, monkeypatch, metric):
    monkeypatch.setattr(ap, "CELL_ROWS", 100)
    monkeypatch.setattr(ap, "BLOCK_CODES", 128)  # cells of several blocks, several lanes
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 2
    data = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))).astype(np.float32)
    data[7] = 0
    vectors = rows(spark, data)
    index = ap.build_approximate(vectors, metric)
    queries = rows(spark, data[:300]).withColumnRenamed("index", "query_id")
    assert len(index.centres) >= 29 and index.probes_for(0.97) < 29
    exact = nb.knn(queries, vectors, 5, metric)
    found = ap.approximate_knn(queries, index, 5)
    scored = ap.recall_at(found, exact).first()
    assert scored["n_true"] == 5 * (299 if metric == "cosine" else 300)
    assert scored["recall"] >= 0.9
    both = found.join(exact, ["query_id", "index"]).select(
        F.max(F.abs(found["distance"] - exact["distance"]))).first()[0]
    assert both <= 2e-6
    whole = ap.approximate_knn(queries, index, 5, probes=30, refine=600)
    assert ap.recall_at(whole, exact).first()["recall"] == 1.0


def test_approximate_search_of_few_vectors(spark):
    vectors = rows(spark, np.eye(3))
    queries = vectors.withColumnRenamed("index", "query_id")
    for given, n in ((vectors, 9), (vectors.where("index = 1"), 3), (vectors.where("false"), 0)):
        assert ap.approximate_knn(queries, ap.build_approximate(given), 5).count() == n


def test_zero_vectors_are_named(spark):
    queries = rows(spark, [[0, 0], [1, 0]]).withColumnRenamed("index", "query_id")
    assert [r["query_id"] for r in nb.no_direction(queries).collect()] == [0]


def test_small_corpus_is_not_padded(spark):
    vectors = rows(spark, np.eye(3))
    found = nb.knn(vectors.withColumnRenamed("index", "query_id"), vectors, 5)
    assert found.groupBy("query_id").count().select("count").distinct().collect() == [(3,)]


def test_empty_corpus(spark):
    vectors = rows(spark, np.eye(3))
    found = nb.knn(vectors.withColumnRenamed("index", "query_id"), vectors.where("false"), 5)
    assert found.count() == 0


def test_vector_table_rejects(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (None, [1.0, 2.0]),
                                (5, [1.0, None])], "index long, vec array<float>")
    valid, rejects = nb.build_vectors(df, 2)
    assert [r["index"] for r in valid.collect()] == [1]
    assert sorted(r.reason for r in rejects.collect()) == [
        "no key", "no vector", "not a number", "wrong dimension"]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [6.0, 8.0])],
                               "a array<float>, b array<float>, c array<float>")
    row = df.select(vf.l2_distance("a", "b"), vf.norm(F.col("a")), vf.cosine(F.col("a"), F.col("c")),
                    vf.dot(F.col("a"), F.col("c"))).first()
    assert list(row) == pytest.approx([5.0, 5.0, 1.0, 50.0])
    narrow = df.select(vf.single_precision(F.col("a").cast("array<double>")).alias("x"))
    assert narrow.schema["x"].dataType.simpleString() == "array<float>"


def test_hashed_vectors_have_unit_length(spark, index):
    lengths = hashed_vectors(index.docs).select("index", vf.norm(F.col("vec")).alias("n")).collect()
    assert {r["index"] for r in lengths} == {1, 2, 3, 5, 6}
    assert [r.n for r in lengths] == pytest.approx([1.0] * 5, abs=1e-5)


def test_encoder_hook(spark):
    import pandas as pd

    def encoder(batches):
        for batch in batches:
            yield pd.DataFrame({"index": batch["index"],
                                "vec": [[float(len(t)), 0.0] for t in batch["text"]]})
    texts = spark.createDataFrame([("q", "abc")], "query_id string, query string")
    row = embed_texts(texts, "query_id", "query", encoder=encoder).first()
    assert (row.query_id, list(row.vec)) == ("q", [3.0, 0.0])


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, index long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, index long, rank int")
    fused = fuse(a, b, k=3).orderBy("rank").collect()
    assert [r["index"] for r in fused] == [11, 10, 12]
    assert fused[0].score == round(1 / 61 + 1 / 62, 6)


def test_result_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "index long, text string")
    queries = spark.createDataFrame([(1, "the soup basil")], "query_id long, query string")
    results = [sorted(map(tuple, ft.search(
        queries, ft.build_index(docs.repartition(n), buckets=n), 4).collect())) for n in (1, 3)]
    assert results[0] == results[1]


def test_postings_are_unpacked_behind_their_exchange(spark, tmp_path, capsys):
    from larder.catalogue import queries
    (spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
     .write.parquet(str(tmp_path / "documents.parquet")))
    found = queries.fts_postings(spark, str(tmp_path))
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Generate explode") == 1
    assert plan.index("Generate explode") < plan.index("Join")  # read from below
    got = {(r.term, r["index"]): (r.tf, r.doc_len, r.df) for r in found.collect()}
    assert got["tomato", 1] == (2, 7, 1) and got["soup", 2] == (1, 2, 2) and len(got) == 19


def test_join_unique_with_a_hot_key(spark):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left"):
        ours = join_unique(left, right, "k", how, share=0.1)
        assert sorted(map(tuple, ours.collect()), key=str) == sorted(
            map(tuple, left.join(right, "k", how).collect()), key=str)


def test_task_functions_need_no_installed_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle
    packed = tmp_path / "function"
    packed.write_bytes(cloudpickle.dumps(nb._nearest_pairs))
    code = ("import pickle, numpy as np; f = pickle.loads(open(%r, 'rb').read());"
            "print(f(np.eye(2), np.eye(2), 'l2', 1, np.ones(2))[1].tolist())" % str(packed))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "[0, 1]", out.stderr


def test_nearest_pivots_are_found_in_strips(monkeypatch):
    made = np.random.default_rng(5)
    rows, pivots = made.normal(size=(500, 8)).astype(np.float32), made.normal(size=(40, 8))
    held, gaps = [], nb._gaps
    monkeypatch.setattr(nb, "PAIR_BYTES", 32 * 48 * 16)  # of 16 rows
    monkeypatch.setattr(nb, "_gaps", lambda a, b: held.append(len(a)) or gaps(a, b))
    cell, gap = nb._nearest_pivot(rows, pivots, "l2", 1.0)
    assert max(held) == 16 and sum(held) == 500
    apart = np.linalg.norm(rows[:, None] - pivots[None], axis=2)
    assert (cell == apart.argmin(axis=1)).all() and np.allclose(gap, apart.min(axis=1))


def test_hashed_vectors_are_summed_inside_their_rows(spark, index, capsys):
    hashed_vectors(index.docs).explain()
    assert "Exchange" not in capsys.readouterr().out
    found = {r["index"]: r.vec for r in hashed_vectors(index.docs).collect()}
    # a text without terms has no vector, also where a filter on the vector comes first
    assert hashed_vectors(index.docs).select(F.explode("vec")).count() == 5 * 256
    # rows with one index, also without any, are one text
    twice = index.docs.where("index in (1, 2)").withColumn(
        "index", F.when(F.col("index") == 2, F.lit(None)).otherwise(F.col("index")))
    both = {r["index"]: r.vec for r in hashed_vectors(
        index.docs.where("index = 6").unionByName(twice).unionByName(twice)).collect()}
    assert set(both) == {1, 6, None} and both[6] == found[6]
    assert np.allclose(both[1], found[1], atol=2e-6) and np.allclose(both[None], found[2], atol=2e-6)


def test_queries_of_one_file_visit_on_all_cores(spark):
    vectors = rows(spark, np.eye(6, dtype=np.float32)).coalesce(1)
    index = nb.build_vector_index(vectors)
    visits = nb.visits_of(vectors.withColumnRenamed("index", "query_id"), index, 2)
    assert visits.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e3])
@pytest.mark.parametrize("metric", nb.METRICS)
def test_screened_pairs_are_those_of_double_precision(metric, scale):
    rng = np.random.default_rng(5)
    b = (rng.normal(size=(400, 16)) * scale).astype(np.float32).astype(float)
    a = np.vstack([b[:20], (rng.normal(size=(30, 16)) * scale).astype(np.float32)])
    if metric == "cosine":
        a, b = nb._unit(a), nb._unit(b)
    order = nb._order(a @ b.T, metric, (a * a).sum(1)[:, None], (b * b).sum(1)[None, :])
    most = np.sort(order, axis=1)[:, 1] + 1e-9 * scale ** 2
    row, column = nb._screened(a, b, metric, most)
    assert len(row) < nb.SCREENED * order.size
    assert set(zip(*np.nonzero(order <= most[:, None]))) <= set(zip(row, column))
    assert nb._screened(a, b, metric, np.full(len(a), np.inf)) is None
    assert nb._screened(a * 1e35, b, metric, most) is None


@pytest.mark.parametrize("metric", nb.METRICS)
def test_found_values_lower_the_bound(metric):
    rng = np.random.default_rng(6)
    a, b = nb._unit(rng.normal(size=(5, 8))), nb._unit(rng.normal(size=(60, 8)))
    most, nearest = np.full(5, np.inf), np.full((5, 3), nb.FAR)
    values = []
    for at in range(0, 60, 20):
        row, _, value = nb._nearest_pairs(a, b[at:at + 20], metric, 3, most)
        nb._tighten(most, nearest, row, value, metric)
        values.append((row, value))
    row, value = (np.concatenate(x) for x in zip(*values))
    _, _, best = nb._nearest_pairs(a, b, metric, 3, np.full(5, np.inf))
    for i in range(5):
        assert sorted(value[row == i])[:3] == list(best[3 * i:3 * i + 3]) == sorted(nearest[i])
    assert np.isfinite(most).all() and len(row) < 5 * 9


def test_lists_are_built_from_whole_documents(spark):
    texts = [(1, "b a b"), (2, "a"), (None, "a c"), (3, ""), (4, None), (2, "a a")]
    docs = spark.createDataFrame(texts, "index long, text string")
    for block_docs in (1, 100):
        index = ft.build_index(docs, buckets=4, block_docs=block_docs)
        found = sorted((tuple(r) for r in index.postings.collect()), key=str)
        assert found == sorted([
            ("a", 1, 1, 3), ("b", 1, 2, 3), ("a", 2, 1, 1), ("a", 2, 2, 2),
            ("a", None, 1, 2), ("c", None, 1, 2)], key=str)
        assert dict(index.term_df.collect()) == {"a": 4, "b": 1, "c": 1}
    # the rows of one block, not their postings, cross the exchange
    stored = index.docs.withColumn("block", F.lit(0).cast("long"))
    table = stored.where(F.size("terms") > 0).select(
        "block", "index", "doc_len", "terms").toArrow()
    lists = ft._lists_of_block(table)
    assert sorted(lists.column("term").to_pylist()) == ["a", "b", "c"]
    assert lists.schema.names == ["block", "term", "entries"]


def sparse_rows(n, rng, dim=32, entries=2):
    data = np.zeros((n, dim), np.float32)
    for row in data:
        row[rng.choice(dim, entries, replace=False)] = rng.normal(size=entries)
    return data


@pytest.mark.parametrize("metric", nb.METRICS)
@pytest.mark.parametrize("sparse", [True, False])
def test_bundles_read_in_place_give_what_copies_give(spark, monkeypatch, metric, sparse):
    monkeypatch.setattr(nb, "CELL_ROWS", 40)
    monkeypatch.setattr(nb, "SAMPLE_ROWS", 60)
    monkeypatch.setattr(nb, "SPARSE_COLUMNS", 16)
    rng = np.random.default_rng(8)
    data = np.vstack([np.repeat(rng.normal(size=(1, 32)), 60, axis=0),
                      rng.normal(size=(540, 32))]).astype(np.float32)
    index = nb.build_vector_index(rows(spark, data), metric, block_bytes=4 * 32 * 70)
    asked = sparse_rows(500, rng) if sparse else data[50:550]
    asked[7] = 0
    queries = rows(spark, asked).selectExpr("if(index = 9, 8, index) as query_id", "vec")
    found = {}
    for sent in (0, 1e9):
        monkeypatch.setattr(nb, "SENT", sent)
        found[sent] = sorted(map(tuple, nb.knn(queries, index, 7).collect()))
    assert found[0] == found[1e9] and len(found[0]) >= 498 * 7


def test_what_is_sent_does_not_grow_with_the_bundles(spark, monkeypatch, capsys):
    monkeypatch.setattr(nb, "CELL_ROWS", 20)
    data = np.random.default_rng(9).normal(size=(600, 16)).astype(np.float32)
    index = nb.build_vector_index(rows(spark, data), "l2", block_bytes=4 * 16 * 20)
    queries = rows(spark, data).withColumnRenamed("index", "query_id")
    # every query needs nearly all bundles, and would be copied to each
    assert nb.visits_of(queries, index, 5).count() > 3 * nb.SENT * len(data)
    nb.knn(queries, index, 5).explain()
    plan = capsys.readouterr().out
    assert "MapInPandas" in plan and "FlatMapCoGroupsInPandas" not in plan


def test_sparse_queries_are_screened_by_their_entries(monkeypatch):
    rng = np.random.default_rng(10)
    a, b = sparse_rows(40, rng).astype(float), rng.normal(size=(300, 32))
    for metric in nb.METRICS:
        ours, theirs = (nb._unit(a), nb._unit(b)) if metric == "cosine" else (a, b)
        order = nb._order(ours @ theirs.T, metric, (ours * ours).sum(1)[:, None],
                          (theirs * theirs).sum(1)[None, :])
        most = np.sort(order, axis=1)[:, 5] + 1e-9
        lines, take = [], np.take
        monkeypatch.setattr(np, "take", lambda x, i, *o, **n: lines.append(len(i)) or take(x, i, *o, **n))
        row, column = nb._screened(ours, theirs, metric, most)
        monkeypatch.setattr(np, "take", take)
        assert sum(lines) <= 3 * len(a)  # of 32 entries, and one for the length
        assert set(zip(*np.nonzero(order <= most[:, None]))) <= set(zip(row, column))
        assert len(row) < 2 * 6 * len(a)


def random_texts(rng, n, words=60):
    return [" ".join(f"w{int(w)}" for w in np.minimum(rng.zipf(1.4, rng.integers(1, 30)), words))
            for _ in range(n)]


@pytest.mark.parametrize("key", ["long", "string"])
def test_blocks_read_in_place_give_what_a_broadcast_gives(spark, monkeypatch, capsys, key):
    rng = np.random.default_rng(14)
    texts = random_texts(rng, 300)
    docs = spark.createDataFrame(
        [(str(i // 2 if i < 20 else i), t) for i, t in enumerate(texts)],
        "index string, text string").withColumn("index", F.col("index").cast(key))
    index = ft.build_index(docs, buckets=4, block_docs=20)
    asked = [(f"q{i % 80}", t) for i, t in enumerate(random_texts(rng, 90, 80))]
    queries = spark.createDataFrame([*asked, (None, "w1"), ("none", "unknown")],
                                    "query_id string, query string")
    found = {}
    for rows, results in ((ft.BROADCAST_ROWS, ft.RESULTS), (200, ft.RESULTS), (200, 40)):
        monkeypatch.setattr(ft, "BROADCAST_ROWS", rows)
        monkeypatch.setattr(ft, "RESULTS", results)
        found[rows, results] = sorted(map(tuple, ft.search(queries, index, 4).collect()), key=str)
    first, *others = found.values()
    assert len(first) > 300 and all(other == first for other in others)
    # what the blocks hand on stays in the task
    ft.search(queries, index, 4).explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "FlatMapGroupsInArrow" not in plan and "Window" not in plan


@pytest.mark.parametrize("floors", [0.0, 1.5, 4.0])
def test_merged_lists_give_what_the_product_gives(monkeypatch, floors):
    rng = np.random.default_rng(15)
    n, terms, asking = 300, 40, 50
    lists = [sorted(rng.choice(n, n // (t + 1), replace=False)) for t in range(terms)]
    entries = {"index": np.concatenate(lists) * 3,
               "start": np.append(0, np.cumsum([len(x) for x in lists]))}
    entries["tf"] = rng.integers(1, 5, len(entries["index"]))
    entries["doc_len"] = 10 + entries["index"] % 17
    weight = np.linspace(0.1, 3.0, terms)
    asks = [sorted(rng.choice(terms, 1 + q % 9, replace=False)) for q in range(asking)]
    query = np.repeat(np.arange(asking), [len(a) for a in asks])
    term = np.concatenate(asks)
    results = []
    for sparse in (0, ft.SPARSE, 1e9):  # lists alone, either, the product alone
        monkeypatch.setattr(ft, "SPARSE", sparse)
        row, ids, score, matched = ft._score(
            entries, query, term, weight[term], np.full(asking, floors), 5, 15.0)
        order = np.lexsort((ids, -score, row))
        results.append([x[order].tolist() for x in (row, ids, score, matched)])
    assert results[0] == results[1] == results[2] and len(results[0][0]) > asking
    gain = np.zeros((terms, 3 * n))
    for t in range(terms):
        own = slice(entries["start"][t], entries["start"][t + 1])
        tf, length = entries["tf"][own], entries["doc_len"][own]
        gain[t, entries["index"][own]] = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 15.0))
    want = []
    for q, own in enumerate(asks):
        score = np.round(weight[own] @ gain[own], 6)
        for i in np.lexsort((np.arange(3 * n), -score))[:5]:
            if score[i] > 0 and score[i] >= floors:
                want.append((q, i, score[i]))
    assert [tuple(x) for x in zip(*results[0][:2])] == [x[:2] for x in want]
    assert results[0][2] == pytest.approx([x[2] for x in want], abs=2e-6)


def test_the_best_of_blocks_raise_the_floor():
    best, rng = ft._Best(3, 2), np.random.default_rng(16)
    given = []
    for at in range(20):
        row, score = np.sort(rng.integers(0, 2, 5)), np.round(rng.random(5), 6)
        ids = 10 * at + np.arange(5)
        given += zip(row.tolist(), (-score).tolist(), ids.tolist())
        best.add(row, ids, score, np.ones(5, np.int32))
    want = [x for q in range(2) for x in sorted(g for g in given if g[0] == q)[:2]]
    rank, (row, ids, score, _) = next(best.strips())
    assert list(zip(row, -score, ids)) == want and rank.tolist() == [1, 2, 1, 2]
    assert best.floor[:2] == pytest.approx([-want[1][1] - 1e-5, -want[3][1] - 1e-5])
    assert best.floor[2] == 0.0


def test_fusion_shuffles_once(spark, capsys):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, index long, rank int")
    fuse(a, a, k=3).explain()
    assert capsys.readouterr().out.count("Exchange hashpartitioning") == 1
