import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larder.operators import assess as judging
from larder.operators import hooks, prompts, rewrite
from larder.operators.fulltext import build_index
from larder.operators.sampling import sample_rows
from larder.plans import recommend as plan

RECIPES = [
    (1, "Onion Soup", ["onion", "butter", "beef broth"], "Simmer the onions in broth for soup"),
    (2, "Tomato Soup", ["tomato paste", "basil"], "Simmer tomato and basil for a soup"),
    (3, "Caprese Salad", ["tomato", "mozzarella", "basil"], "Slice tomato and serve the salad"),
    (4, "Chicken Curry", ["chicken", "rice", "curry powder"], "Cook chicken in the curry"),
    (5, "Vegetable Curry", ["carrots", "rice", "curry powder"], "Cook vegetables in the curry"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    df = spark.createDataFrame(
        RECIPES, "index long, title string, ingredients array<string>, instructions string")
    return df.withColumn("image_name", F.lower(F.regexp_replace("title", " ", "-"))).withColumn(
        "text", F.concat_ws(". ", "title", F.array_join("ingredients", ", "), "instructions"))


@pytest.fixture(scope="module")
def index(corpus):
    return build_index(corpus, buckets=2)


def split(spark, *queries):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(queries)],
                               "query_id long, query string")
    return [(" ".join(r.kept), r.excluded_ingredients)
            for r in rewrite.split_exclusions(df).orderBy("query_id").collect()]


def test_exclusions(spark):
    assert split(
        spark, "soup without carrots or celery", "salad with no chicken",
        "dessert recipe excluding dairy", "chocolate dessert for two, no dairy",
        "Pasta without nuts, soy sauce and eggs for two", "vegetarian pasta dish",
        "curry no nuts no rice. Something spicy", "ñno soup", "", None) == [
        ("soup", ["carrots", "celery"]), ("salad with", ["chicken"]),
        ("dessert recipe", ["dairy"]), ("chocolate dessert for two", ["dairy"]),
        ("pasta for two", ["nuts", "soy sauce", "eggs"]), ("vegetarian pasta dish", []),
        ("curry something spicy", ["nuts", "rice"]), ("ñno soup", []), ("", []), ("", None)]


def fixes(spark, unknown, vocabulary):
    return {r.term: (r.fix, r.distance) for r in rewrite.corrections(
        spark.createDataFrame([(t,) for t in unknown], "term string"),
        spark.createDataFrame(vocabulary, "term string, df long")).collect()}


def test_spelling(spark):
    assert fixes(spark, ["oniins", "adocixn", "zzzzzz", "chiken"], [
        ("onions", 5), ("soup", 9), ("adoción", 2), ("chicken", 3), ("chickens", 9)]) == {
        "oniins": ("onions", 1), "adocixn": ("adoción", 1), "chiken": ("chicken", 1)}
    # closest, then most frequent, then first
    assert fixes(spark, ["cat"], [("cart", 1), ("bat", 5), ("rat", 5)])["cat"][0] == "bat"


def test_spelling_finds_all_within_two_edits(spark):
    import itertools
    import random

    random.seed(3)
    words = sorted({"".join(random.choices("abc", k=random.randint(3, 7))) for _ in range(120)})
    unknown, known = words[::2], words[1::2]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, left = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y)))
        return row[-1]
    want = {}
    for a, b in itertools.product(unknown, known):
        d = edits(a, b)
        if d <= 2:
            want[a] = min(want.get(a, (9, "")), (d, b))
    ours = fixes(spark, unknown, [(k, 1) for k in known])
    assert ours == {a: (b, d) for a, (d, b) in want.items()}


def test_words_of_the_corpus_are_not_corrected(spark):
    term_df = spark.createDataFrame([("quinoa", 1), ("quinta", 9), ("salad", 9)],
                                    "term string, df long")
    words = spark.createDataFrame([(t,) for t in ("quinoa", "salat", "sal", "x" * 5000)],
                                  "term string")
    assert {r.term: (r.known, r.fix) for r in rewrite.look_up(words, term_df).collect()} == {
        "quinoa": (True, None), "salat": (False, "salad"), "sal": (False, None),
        "x" * 5000: (False, None)}


def test_rewrite_and_gate(spark, index):
    df = spark.createDataFrame([
        (1, "tomatto soup without onion"), (2, "what's the weather like today"), (3, "no nuts")],
        "query_id long, query string")
    out = {r.query_id: r for r in rewrite.rewrite(df, index.term_df).collect()}
    assert out[1].is_recipe_request and out[1].adjusted_query == "tomato soup"
    assert out[1].excluded_ingredients == ["onion"]
    assert out[1].adjustments == ["Corrected tomatto to tomato", "Excluded onion"]
    assert not out[2].is_recipe_request
    assert not out[3].is_recipe_request and out[3].adjusted_query == ""
    valid, rejected = rewrite.gate(rewrite.rewrite(df, index.term_df))
    assert (valid.count(), rejected.count()) == (1, 2)


def test_exclusion_hits(spark):
    df = spark.createDataFrame([(1, ["tomato", "Tomato paste", "rice"], ["tomato", "nuts"])],
                               "index long, ingredients array<string>, excluded_ingredients array<string>")
    assert sorted(map(tuple, judging.exclusion_hits(df).collect())) == [
        (1, "tomato", "Tomato paste", "partial"), (1, "tomato", "tomato", "exact")]


def test_assess(spark):
    df = spark.createDataFrame([
        (1, "tomato soup", "tomato soup here", ["tomato", "salt"], []),
        (2, "tomato soup", "tomato soup here", ["tomato", "salt"], ["tomato"]),
        (3, "tomato soup", "tomato soup here", ["tomato paste"], ["tomato"]),
        (4, "tomato soup", "tomato only", ["x"], []),
        (5, "tomato soup", "tomato only", ["tomato", "salt"], ["tomato", "salt"]),
        (6, "", "tomato", ["x"], [])],
        "index long, query string, text string, ingredients array<string>, "
        "excluded_ingredients array<string>")
    out = {r["index"]: r for r in judging.assess(df).collect()}
    assert {i: r.relevance_score for i, r in out.items()} == {1: 10, 2: 5, 3: 7, 4: 5, 5: 0, 6: 0}
    assert out[4].is_relevant and not out[5].is_relevant
    assert out[3].reason == "Matches 2 of 2 query terms; excluded within an ingredient tomato"


def test_validation(spark):
    df = spark.createDataFrame(
        [("a", True, "r", -1), ("b", True, "r", 0), ("c", True, "r", 10), ("d", True, "r", 11),
         ("e", True, None, 5), (None, True, "r", 5)],
        "title string, is_relevant boolean, reason string, relevance_score int")
    valid, rejects = judging.check_assessments(df)
    assert sorted(r.title for r in valid.collect()) == ["b", "c"]
    assert {(r.title, r.reject_reason) for r in rejects.collect()} == {
        ("a", "score out of range"), ("d", "score out of range"), ("e", "missing reason"),
        (None, "missing title")}
    rows = spark.createDataFrame(
        [(True, "q", "q", None, None, "r"), (None, "q", "q", [], [], "r")],
        "is_recipe_request boolean, original_query string, adjusted_query string, "
        "excluded_ingredients array<string>, adjustments array<string>, reasoning string")
    valid, rejects = judging.check_rewritten(rows)
    assert valid.first().adjustments == []
    assert rejects.first().reject_reason == "missing is_recipe_request"


def test_combine_by_key(spark):
    found = spark.createDataFrame([(1, i, i) for i in range(1, 6)],
                                  "query_id long, index long, rank int")
    # in another order than retrieved; one is missing
    judged = spark.createDataFrame(
        [(1, 4, True, 6), (1, 3, True, 7), (1, 1, False, 9), (1, 2, True, 7)],
        "query_id long, index long, is_relevant boolean, relevance_score int")
    best = judging.combine(found, judged, 3, 7).orderBy("position").collect()
    assert [(r.position, r["index"]) for r in best] == [(1, 2), (2, 3)]


def test_recommend(spark, index, corpus):
    requests = spark.createDataFrame([
        ("a", "tomato soup without onion"), ("b", "curry without chicken"),
        ("c", "what's the weather like today"), ("d", "basil without basil")],
        "query_id string, query string")
    shown, outcome, results = plan.answer(requests, index, corpus)
    status = {r.query_id: (r.status, r.recommendations) for r in outcome.collect()}
    assert status["c"] == ("rejected", 0)
    assert status["a"][0] == "recommended"
    first = {r.query_id: r["index"] for r in results.recommended.where("position = 1").collect()}
    assert first["a"] == 2 and first["b"] == 5
    retrieved = {(r.query_id, r["index"]) for r in results.retrieved.collect()}
    assessed = {(r.query_id, r["index"]) for r in results.assessed.collect()}
    recommended = {(r.query_id, r["index"]) for r in results.recommended.collect()}
    assert recommended <= assessed <= retrieved
    assert shown.where("query_id = 'a'").first().summary.startswith("Adjusted query: tomato soup")


def test_retrieve(spark, index, corpus):
    queries = spark.createDataFrame([("a", "caprese")], "query_id string, query string")
    row = plan.retrieve(queries, index, corpus).first()
    assert row.ingredients == "1. tomato\n2. mozzarella\n3. basil"
    assert row.image_path == "data/Food_Images/caprese-salad.jpg"


@pytest.mark.parametrize("named", [judging.NAMED_KEYS, 0])
def test_fetch(spark, corpus, monkeypatch, named):
    monkeypatch.setattr(judging, "NAMED_KEYS", named)
    found = spark.createDataFrame([("q", 1), ("r", 1), ("r", 4)], "query_id string, index long")
    rows = judging.fetch(found, corpus, "title").orderBy("query_id", "index").collect()
    assert [(r.query_id, r.title) for r in rows] == [
        ("q", "Onion Soup"), ("r", "Onion Soup"), ("r", "Chicken Curry")]


def test_judge_prompt(spark):
    df = spark.createDataFrame(
        [("q", "soup", ["nuts", "milk"], r, f"T{r}", ["a", "b"], "Cook") for r in (2, 1, 3)],
        "query_id string, query string, excluded_ingredients array<string>, rank int, "
        "title string, ingredients array<string>, instructions string")
    message = judging.judge_prompts(df, 2).first().message
    assert message == (
        "Query: soup\nExcluded Ingredients: nuts, milk\n\nRecipes:\n"
        "Recipe 1:\nTitle: T1\nIngredients: 1. a\n2. b\nInstructions: Cook\n\n"
        "Recipe 2:\nTitle: T2\nIngredients: 1. a\n2. b\nInstructions: Cook")


def test_every_document_is_accounted_for(spark):
    texts = {1: "ab cd", 2: "", 3: "apple pear plum", 4: "apple pear", 5: "apple x", 6: None}
    index = build_index(spark.createDataFrame(list(texts.items()), "index long, text string"))
    known = {r["index"]: r.prompts for r in prompts.known_item_prompts(index).collect()}
    rejects = {r["index"]: r.reason for r in prompts.prompt_rejects(index).collect()}
    assert set(known) == {1, 3, 4, 5}
    assert all(set(p.split()) == {"ab", "cd"} for p in known[1])
    assert all(p == "apple" for p in known[5])
    assert rejects == {2: "no term", 6: "no term", 3: "no absent term"}
    for among in (1, 200):
        named = {r["index"]: r.prompts
                 for r in prompts.negation_prompts(index, among=among).collect()}
        assert set(named) == {1, 4, 5}
        for i, listed in named.items():
            absent = [t for t in ("apple", "pear", "plum") if t not in texts[i].split()][:among]
            assert len(listed) == 5
            assert {p.split(" without ")[1] for p in listed} <= set(absent)


def test_prompts(spark, index):
    known = prompts.known_item_prompts(index)
    rows = prompts.valid_prompts(known).collect()
    assert len(rows) == 5 and all(r.error is None for r in rows)
    assert all(3 <= len(p.split()) <= 5 for r in rows for p in r.prompts)
    texts = {i: (t + " " + " ".join(g) + " " + s).lower() for i, t, g, s in RECIPES}
    for row in prompts.negation_prompts(index).collect():
        for prompt in row.prompts:
            assert prompt.split(" without ")[1] not in texts[row["index"]].split()
    vectors = prompts.embed_prompt_lists(known).collect()
    assert all(len(r.vectors) == 5 and len(r.vectors[0]) == 256 for r in vectors)
    only = prompts.known_item_prompts(index, spark.createDataFrame([(2,)], "index long"))
    assert only.collect() == known.where("index = 2").collect()


def test_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "index")
    assert sample_rows(df, 7).collect() == sample_rows(df.repartition(5), 7).collect()
    assert sample_rows(df, 7, seed=1).collect() != sample_rows(df, 7).collect()
    with pytest.raises(ValueError):
        sample_rows(df, 101)
    assert sample_rows(df, 101, strict=False).count() == 100


def test_model_hook(spark, tmp_path):
    def call(batch):
        marker = tmp_path / str(batch["query_id"].iloc[0])
        if not marker.exists():
            marker.write_text("")
            raise RuntimeError("first call fails")
        return batch[["query_id"]].assign(score=1)

    def never(batch):
        raise RuntimeError("no model")
    df = spark.range(10).withColumnRenamed("id", "query_id")
    good, bad = hooks.split_failures(
        hooks.call_model(df, call, "query_id long, score int", wait=0.0))
    assert (good.count(), bad.count()) == (10, 0)
    failed = hooks.call_model(df, never, "query_id long, score int", wait=0.0)
    assert failed.where("error = 'no model' and score is null").count() == 10

    def picky(batch):
        if (batch["query_id"] == 3).any():
            raise RuntimeError("not this one")
        return batch[["query_id"]].assign(score=1)
    good, bad = hooks.split_failures(
        hooks.call_model(df, picky, "query_id long, score int", parallel=1, wait=0.0))
    assert good.count() == 9 and [r.query_id for r in bad.collect()] == [3]


def test_answers_are_kept(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)

    def call(batch):
        asked.add(len(batch))
        if (batch["query_id"] == 3).any():
            raise RuntimeError("not this one")
        return batch[["query_id"]].assign(score=(batch["query_id"] * 2).astype("int32"))

    df = spark.range(40).withColumnRenamed("id", "query_id")
    seen = []
    for n in range(3):
        answers = hooks.call_model(df, call, "query_id long, score int", parallel=3, rows=4,
                                   window=2, wait=0.0, store=str(tmp_path / "answers")).collect()
        assert {r.query_id: r.score for r in answers if r.error is None} == {
            i: 2 * i for i in range(40) if i != 3}
        seen.append(asked.value)
    # the second run asks anew only for the part that failed, and its failing row
    assert seen[0] >= 40 and 0 < seen[1] - seen[0] <= 4 + 3 and seen[2] - seen[1] <= 4 + 3


def test_rows_that_a_model_fails_are_rewritten_by_rule(spark, index):
    def call(batch):
        if batch["query"].str.contains("soup").any():
            raise RuntimeError("no soup")
        return batch[["query_id"]].assign(
            is_recipe_request=True, original_query=batch["query"], adjusted_query="by model",
            excluded_ingredients=[[]] * len(batch), adjustments=[[]] * len(batch), reasoning="")

    df = spark.createDataFrame([(1, "onion soup"), (2, "rice curry")],
                               "query_id long, query string")
    found = {r.query_id: (r.adjusted_query, r.answered_by) for r in rewrite.rewrite_by_model(
        df, call, index.term_df, wait=0.0).collect()}
    assert found == {1: ("onion soup", "rules"), 2: ("by model", "model")}


@pytest.mark.parametrize("cells", [2, 64, 1 << 21])
def test_only_terms_that_can_be_among_the_first_are_handed_on(spark, cells):
    # every word of the first 30 is in all documents, the others in a few or one
    texts = {i: " ".join([f"common{j}" for j in range(30)] + [f"w{(i * 7 + j) % 61}" for j in range(9)]
                         + [f"rare{i}x{j}" for j in range(40)] + ["zz"] * 5) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()) + [(3, "pear " + texts[3]), (None, "ab cd")],
                                 "index long, text string")
    index = build_index(docs)
    handed = prompts._may_be_top(index.docs, index, 8, cells).groupBy("index").count().collect()
    if cells > 64:
        assert max(r["count"] for r in handed) <= 20  # of two rows
    lists = [(r["index"], {t.term: t.tf for t in r.terms}) for r in index.docs.collect()]
    df = Counter(t for _, terms in lists for t in terms)
    for key in [*texts, None]:
        pairs = [(len(t) < 3, -round(n * math.log((1 + len(lists)) / (1 + df[t])), 6), t)
                 for i, terms in lists if i == key for t, n in terms.items()]
        found = prompts.top_terms(index, cells=cells).where(
            F.col("index").eqNullSafe(F.lit(key))).orderBy("rank").collect()
        assert [(r.term, r.weight) for r in found] == [(t, -w) for _, w, t in sorted(pairs)[:8]]


def test_rows_that_a_model_names_as_rejected_cost_no_calls_of_their_own(spark, index, tmp_path):
    calls, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def call(batch):
        calls.add(1)
        asked.add(len(batch))
        odd = batch["query_id"] % 2 == 1
        return batch[["query_id"]].assign(
            is_recipe_request=True, original_query=batch["query"], adjusted_query=batch["query"],
            excluded_ingredients=[[]] * len(batch), adjustments=[[]] * len(batch), reasoning="",
            error=odd.map({True: "odd", False: None}))

    df = spark.range(256).selectExpr("id AS query_id", "'rice curry' AS query")
    seen = []
    for n in range(2):
        found = {r.query_id: r.answered_by for r in rewrite.rewrite_by_model(
            df, call, index.term_df, wait=0.0, parallel=2, store=str(tmp_path)).collect()}
        assert found == {i: "rules" if i % 2 else "model" for i in range(256)}
        seen.append((calls.value, asked.value))
    assert seen[0][0] <= 2 * 6 and seen[0][1] == 256 + 128
    # answers are kept, and only those rejected are asked again
    assert seen[1][1] - seen[0][1] == 2 * 128


def test_work_on_few_bytes_is_dealt_to_all_cores(spark, tmp_path):
    from larder.catalogue import inputs
    rows = [(i, f"red soup{i}", "B#1", "FRESH STEW") for i in range(40)] + [(None, "x", "B", "C")]
    parts = spark.createDataFrame(
        rows, "p_partkey long, p_name string, p_brand string, p_type string")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    recipes = inputs.recipes(spark, str(tmp_path))
    cores = spark.sparkContext.defaultParallelism
    assert recipes.rdd.getNumPartitions() >= cores
    assert recipes.count() == 41
    words = spark.createDataFrame([(f"wort{i}xy",) for i in range(200)], "term string").coalesce(1)
    vocabulary = spark.createDataFrame([("word7xy", 3), ("other", 5)], "term string, df long")
    found = rewrite.corrections(words, vocabulary)
    dealt = rewrite.corrections(words, F.broadcast(vocabulary)).rdd.getNumPartitions()
    assert {r.term: r.fix for r in found.collect()}["wort7xy"] == "word7xy"
    assert dealt >= cores
