import time
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larder.operators import audit, lookups, metrics, reports
from larder.plans.feedback import fan_out
from larder.plans.ingest import ingest
from larder.plans.recommend import answer
from larder.plans.report import performance_report
from larder.schemas import EVENT_LOG, RAW_RECIPES
from larder.session import CHECKPOINT_SETTING, shared_dir
from larder.sources import recipes as src
from larder.sources.eventlog import EventLog
from larder.sources.quoted_csv import read_quoted_csv
from larder.streaming import counters
from larder.streaming import ingest as streams
from larder.streaming import sink as sinks

FEEDBACK = "username string, recipe_title string, feedback string, ts timestamp"


def feedback(spark):
    return spark.createDataFrame(
        [("a", "x", "Liked"), ("b", "x", "Liked"), ("a", "y", "Disliked"),
         ("a", "x", "too salty"), ("b", "y", None)],
        "username string, recipe_title string, feedback string").withColumn(
        "ts", F.to_timestamp(F.lit("2024-03-01 10:00:00")))


def test_feedback_stats(spark):
    assert tuple(reports.feedback_stats(feedback(spark)).first()) == (5, 2, 1, 1)
    empty = feedback(spark).where("false")
    assert tuple(reports.feedback_stats(empty).first()) == (0, None, None, None)
    assert tuple(reports.report_range(empty, empty).first()) == (None, None)
    assert tuple(reports.report_range(feedback(spark), empty).first()) == ("2024-03-01",) * 2
    assert reports.top_recipes(feedback(spark), "Liked", 3).collect() == [("x", 2)]


def test_report_frames(spark):
    scores = spark.createDataFrame([(s,) for s in (0, 5, 5, 10, None)], "relevance_score int")
    frames = performance_report(feedback(spark), feedback(spark).where("false"), scores)
    assert dict(frames["feedback"].collect()) == {
        "Likes": 2, "Dislikes": 1, "Bad Image Reports": 0}
    assert dict(frames["score_histogram"].collect()) == {
        s: {0: 1, 5: 2, 10: 1}.get(s, 0) for s in range(11)}
    density = [r.density for r in frames["score_density"].orderBy("point").collect()]
    assert len(density) == 200 and density[0] == pytest.approx(density[-1], abs=1e-6)
    same = spark.createDataFrame([(5,), (5,)], "relevance_score int")
    assert {r.density for r in metrics.score_density(same).collect()} == {None}
    assert metrics.score_density(same.where("false")).count() == 0


def hits(spark):
    truth = spark.createDataFrame([(q, 100 + q) for q in range(4)], "query_id long, index long")
    found = spark.createDataFrame(
        [(0, 100, 1), (1, 7, 1), (1, 101, 2), (2, 8, 1), (2, 102, 4), (3, 9, 1)],
        "query_id long, index long, rank int")
    stacked = metrics.stack_methods({"one": found, "two": found})
    return metrics.first_hits(stacked, truth, ["one", "two", "none"])


def test_metrics(spark):
    row = metrics.method_metrics(hits(spark)).where("method = 'one'").first()
    assert (row.mrr_1, row.mrr_3, row.mrr_5) == (0.25, 0.375, 0.4375)
    assert (row.recall_1, row.recall_3, row.recall_5) == (0.25, 0.5, 0.75)
    empty = metrics.method_metrics(hits(spark)).where("method = 'none'").first()
    assert (empty.mrr_5, empty.recall_5) == (0.0, 0.0)
    assert metrics.mrr_at_k(hits(spark).where("method = 'one'"), 3).first()[0] == 0.375
    assert metrics.recall_at_k(hits(spark).where("false"), 3).first()[0] is None


def test_best_method_ties_go_to_the_first(spark):
    table = metrics.method_metrics(hits(spark)).withColumn(
        "seconds", F.when(F.col("method") == "one", 2.0).otherwise(1.0))
    best = {r.metric: (r.method, r.shown) for r in
            metrics.best_methods(table).where("is_best").collect()}
    assert best["mrr_3"] == ("one", "0.38 *") and best["seconds"] == ("two", "1.00 *")


def test_ingest_csv(spark, tmp_path):
    raw = tmp_path / "raw.csv"
    raw.write_text(
        "Title,Instructions,Image_Name,Cleaned_Ingredients\n"
        '"The ""Best"" Pie","Mix.\nBake, then cool.",pie,"[\'flour\', ""baker\'s yeast""]"\n'
        "Soup,Boil.,soup,\"['water']\"\n"
        "Bad,Boil.,bad,nan\n", encoding="utf-8")
    corpus, rejects = ingest(spark, str(raw), str(tmp_path / "corpus"))
    rows = {r["index"]: r for r in corpus.collect()}
    assert rows[0].title == 'The "Best" Pie'
    assert rows[0].text_for_search == ('The "Best" Pie. Ingredients: flour, baker\'s yeast. '
                                       "Instructions: Mix.\nBake, then cool.")
    assert rows[1].text_for_embedding == "Soup ['water'] Boil."
    assert [r["index"] for r in rejects.collect()] == [2]
    assert src.create_search_table(corpus, "search_recipes").count() == 2
    assert src.create_search_table(corpus, "search_recipes").count() == 2  # replaced
    with pytest.raises(Exception, match="null in title"):
        src.create_search_table(corpus.withColumn("title", F.lit(None).cast("string")), "broken")
    with pytest.raises(AnalysisException):
        src.read_raw_recipes(spark, str(tmp_path / "missing.csv"))
    with pytest.raises(ValueError, match="missing columns: image_name"):
        src.create_search_table(corpus.drop("image_name"), "broken")
    assert src.read_corpus(spark, str(tmp_path / "corpus")).count() == 2
    src.write_corpus(corpus, str(tmp_path / "csv"), "csv")
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        str(tmp_path / "csv"))
    assert back.count() == 2


def test_rows_are_numbered_across_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(1000).repartitionByRange(5, "id").write.parquet(path)
    numbered = src.number_rows(spark.read.parquet(path)).collect()
    assert [(r["index"]) for r in sorted(numbered, key=lambda r: r["index"])] == list(range(1000))
    assert all(r["id"] == r["index"] for r in numbered)


def test_prompt_vector_and_metric_files(spark, tmp_path):
    prompts = spark.createDataFrame([("1", "t", ["a b", "c"])],
                                    "index string, title string, prompts array<string>")
    src.write_prompts(prompts, str(tmp_path / "p"))
    assert src.read_prompts(spark, str(tmp_path / "p")).first() == (1, "t", ["a b", "c"])
    vectors = spark.createDataFrame([(1, [0.5, 0.25])], "index long, vec array<float>")
    src.write_vectors(vectors, str(tmp_path / "v"))
    assert src.read_vectors(spark, str(tmp_path / "v")).first()["vec"] == [0.5, 0.25]
    src.write_metrics(vectors.select("index"), str(tmp_path / "m"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).count() == 1


def test_event_log(spark):
    log = EventLog(spark, "log_test")
    log.setup()
    log.setup()
    assert log.tables() == sorted(EVENT_LOG)
    users = spark.createDataFrame([("ann",), ("bob",)], "username string")
    sessions = log.create_sessions(users)
    assert {r.session_id for r in sessions.collect()} == {
        r.session_id for r in log.read("user_sessions").collect()}
    ann = sessions.where("username = 'ann'").first().session_id
    stored = log.store_queries(spark.createDataFrame(
        [(ann, "soup", "2024-01-01 10:00:00"), (ann, "pie", "2024-01-02 10:00:00")],
        "session_id string, query string, ts string").withColumn("ts", F.to_timestamp("ts")))
    queries = log.read("user_queries")
    assert {r.id for r in stored.collect()} == {r.id for r in queries.collect()}
    newest = lookups.user_queries(queries, log.read("user_sessions"), username="ann").collect()
    assert [r.query for r in newest] == ["pie", "soup"]
    assert lookups.user_queries(queries, log.read("user_sessions"), session_id="none",
                                username="ann").count() == 0
    log.store_clicks(spark.createDataFrame(
        [(ann, "x", "View Ingredients", "2024-01-05 10:00:00"),
         (ann, "x", "Liked", "2024-01-03 10:00:00")],
        "session_id string, recipe_title string, click_type string, ts string")
        .withColumn("ts", F.to_timestamp("ts")))
    active = lookups.session_activity(
        log.read("user_sessions").where("false"), queries, log.read("user_clicks")).first()
    assert str(active.last_activity) == "2024-01-03 10:00:00" and active.actions == 3
    log.save_feedback(feedback(spark))
    log.save_feedback(feedback(spark))
    assert log.read("user_feedback").count() == 10
    assert lookups.feedback_by_user(log.read("user_feedback"), "b").count() == 4
    assert lookups.feedback_by_recipe(log.read("user_feedback"), "y").count() == 4
    log.store_bad_images(spark.createDataFrame([("a", "x")], "username string, recipe_title string"))
    assert log.read("bad_image_feedback").first().ts is not None
    log.store_adjustments(spark.createDataFrame(
        [(ann, "a", "b", ["nuts"])],
        "session_id string, original_query string, adjusted_query string, "
        "excluded_ingredients array<string>"))
    recent = lookups.recent_adjustments(log.read("query_adjustments")).first()
    assert "**Excluded Ingredients:** nuts" in recent.digest
    orphaned = audit.orphans(
        spark.createDataFrame([("gone",), ("gone",), (ann,)], "session_id string"),
        "session_id", log.read("user_sessions"), "session_id")
    assert orphaned.collect() == [("gone", 2)]
    click = spark.createDataFrame([(ann, "x", "Liked")] * 2,
                                  "session_id string, recipe_title string, click_type string")
    twins = log.store_clicks(click)
    assert len({r.id for r in twins.collect()}) == 2
    assert {r.id for r in twins.collect()} <= {r.id for r in log.read("user_clicks").collect()}
    assert audit.log_audit(log.read).count() == 0
    log.store_clicks(click.withColumn("session_id", F.lit("gone")))
    assert [(r.link, r.key, r.child_rows) for r in audit.log_audit(log.read).collect()] == [
        ("user_clicks.session_id", "gone", 2)]
    log.reset()
    assert all(log.read(t).count() == 0 for t in log.tables())


def test_answers_are_logged(spark):
    from larder.operators.fulltext import build_index
    corpus = spark.createDataFrame(
        [(1, "Onion Soup", ["onion"], "onion soup"), (2, "Tomato Soup", ["tomato"], "tomato soup")],
        "index long, title string, ingredients array<string>, text string")
    log = EventLog(spark, "answer_log")
    log.setup()
    requests = spark.createDataFrame(
        [("q1", "s1", "soup without onion"), ("q2", "s1", "what is the weather")],
        "query_id string, session_id string, query string")
    _, outcome, results = answer(requests, build_index(corpus, buckets=2), corpus, log)
    counts = {t: log.read(t).count() for t in log.tables()}
    assert counts["query_adjustments"] == 2 and counts["user_queries"] == 1
    assert counts["retrieved_recipes"] == counts["assessed_recipes"] == 2
    assert log.read("user_queries").first().query == "soup"
    assert log.read("recommended_recipes").orderBy("position").first().recipe_title == "Tomato Soup"
    trace = lookups.query_trace(
        log.read("user_queries").withColumnRenamed("id", "query_id"), results.retrieved,
        results.assessed, results.recommended)
    assert dict(trace.groupBy("stage").count().collect()) == {
        "query": 1, "retrieved": 2, "assessed": 2, "recommended": 2}
    frames = lookups.trace_of("q1", requests, results.retrieved, results.assessed,
                              results.recommended)
    assert {name: df.count() for name, df in frames.items()} == {
        "query": 1, "retrieved_recipes": 2, "assessed_recipes": 2, "recommended_recipes": 2}


def test_missing_images(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"x")
    listing = src.image_listing(spark, str(tmp_path))
    recipes = spark.createDataFrame(
        [(1, f"file:{tmp_path}/a.jpg"), (2, f"file:{tmp_path}/b.jpg")],
        "index long, image_path string")
    assert [r["index"] for r in audit.missing_images(recipes, listing).collect()] == [2]


ACTIONS = ("event_id long, ts timestamp, session_id string, username string, "
           "recipe_title string, action string, comment string")


def actions(spark, path):
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", f"s{i % 2}", f"u{i % 2}", "pie", a, "salty")
            for i, a in enumerate(["login", "login", "like", "dislike", "comment", "bad_image",
                                   "view_ingredients", "view_instructions"])]
    df = spark.createDataFrame(rows, ACTIONS.replace("ts timestamp", "ts string")).withColumn(
        "ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(f"{path}/in", mode="append")
    df.coalesce(1).write.parquet(f"{path}/in", mode="append")  # delivered twice
    return df, streams.read_stream(spark, f"{path}/in", df.schema)


def event_log(spark, tmp_path):
    return EventLog(spark, "log_" + tmp_path.name.replace("-", "_"), str(tmp_path / "log"))


def test_stream_equals_batch(spark, tmp_path):
    batch, stream = actions(spark, tmp_path)
    written = streams.ingest(stream, event_log(spark, tmp_path))
    for name, rows in fan_out(batch).items():
        ours = written[name].select(*[c for c in rows.columns if c != "id"])
        theirs = rows.select(*ours.columns)
        assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
    clicks = {r.click_type for r in written["user_clicks"].collect()}
    assert clicks == {"Liked", "Disliked", "Detailed Feedback", "Bad Image", "View Ingredients",
                      "View Instructions"}


def test_stream_counters(spark, tmp_path):
    batch, stream = actions(spark, tmp_path)
    daily = counters.daily_counts(stream, F.col("action"))
    assert daily.agg(F.sum("n")).first()[0] == 8  # delivered twice, counted once
    assert {r.day for r in daily.collect()} == {"2024-01-01", "2024-01-02"}
    seen = {r.session_id: r.n for r in counters.sessions(stream).collect()}
    assert seen == {"s0": 4, "s1": 4}


def several_files(spark, path):
    """A folder of four files, one late row in the last, as a stream of one file a batch."""
    rows = [(i, f"2024-01-01 0{i}:00:00", f"s{i % 2}", "u", "pie", "login" if i < 4 else "like",
             None) for i in range(6)] + [(9, "2023-12-01 00:00:00", "s0", "u", "pie", "like", None)]
    df = spark.createDataFrame(rows, ACTIONS.replace("ts timestamp", "ts string")).withColumn(
        "ts", F.to_timestamp("ts"))
    for low in (0, 2, 4, 6):
        part = df.where(f"event_id BETWEEN {low} AND {low + 1}" if low < 6 else "event_id = 9")
        part.coalesce(1).write.parquet(path, mode="append")
        time.sleep(0.02)
    return df, streams.read_stream(spark, path, df.schema, files_per_batch=1)


def test_streams_over_several_batches(spark, tmp_path):
    """The late row of the last file is in the log and in the counts, and is named as late."""
    batch, stream = several_files(spark, str(tmp_path / "in"))
    written = streams.ingest(stream, event_log(spark, tmp_path))
    for name, rows in fan_out(batch).items():
        columns = [c for c in rows.columns if c != "id"]
        assert sorted(map(str, written[name].select(*columns).collect())) == sorted(
            map(str, rows.select(*columns).collect()))
    where = {"folder": str(tmp_path / "states"), "checkpoint": str(tmp_path / "checkpoint")}
    first = {r.session_id: (r.n, str(r.first_ts)[:10])
             for r in counters.sessions(stream, **where).collect()}
    assert first == {"s0": (4, "2023-12-01"), "s1": (3, "2024-01-01")}
    assert [(r.event_id, r.batch) for r in counters.late_events(
        stream, where["folder"]).collect()] == [(9, 3)]
    for event_id in (7, 5):  # a new event, and one delivered again after a restart
        batch.where("event_id = 5").withColumn("event_id", F.lit(event_id).cast("long")).coalesce(
            1).write.parquet(str(tmp_path / "in"), mode="append")
    again = {r.session_id: r.n for r in counters.sessions(stream, **where).collect()}
    assert again == {"s0": 4, "s1": 4}


def test_counts_are_compacted(spark, tmp_path):
    batch, stream = several_files(spark, str(tmp_path / "in"))
    where = {"folder": str(tmp_path / "states"), "checkpoint": str(tmp_path / "checkpoint"),
             "compact_every": 1}
    for n in range(20, 23):
        daily = {(r.day, r.kind): r.n
                 for r in counters.daily_counts(stream, F.col("action"), **where).collect()}
        batch.where("event_id = 5").withColumn("event_id", F.lit(n).cast("long")).coalesce(
            1).write.parquet(str(tmp_path / "in"), mode="append")
    assert daily == {("2024-01-01", "login"): 4, ("2024-01-01", "like"): 4,
                     ("2023-12-01", "like"): 1}
    assert sinks.numbers_of(spark, f"{where['folder']}/snapshots", "upto") == [4, 5]
    assert sinks.numbers_of(spark, f"{where['folder']}/parts", "batch") == [5]


def test_a_batch_that_runs_again_writes_once(spark, tmp_path):
    batch, _ = several_files(spark, str(tmp_path / "in"))
    folder = str(tmp_path / "events")
    for number in (0, 1, 1, 1):
        new = sinks.take_new(batch.where(f"event_id <= {2 * number + 1}"), folder, number,
                             "event_id", "10 minutes")
        assert sorted(r.event_id for r in new.collect()) == [2 * number, 2 * number + 1]
    none = batch.withColumn("event_id", F.lit(None).cast("long"))
    assert sinks.take_new(none, folder, 2, "event_id", "10 minutes").count() == batch.count()
    log = event_log(spark, tmp_path)
    log.setup()
    for _ in range(3):
        log.append("user_clicks", spark.createDataFrame([("s", "pie"), ("s", "pie")],
                                                        "session_id string, recipe_title string"),
                   commit="stream-1")
        log.store_clicks(spark.createDataFrame([("t", "jam")], "session_id string, "
                                                              "recipe_title string"))
    counts = dict(log.read("user_clicks").groupBy("session_id").count().collect())
    assert counts == {"s": 2, "t": 3}


def test_stream_without_rows(spark, tmp_path):
    batch, _ = several_files(spark, str(tmp_path / "in"))
    batch.where("false").write.parquet(str(tmp_path / "none"))
    empty = streams.read_stream(spark, str(tmp_path / "none"), batch.schema)
    assert streams.ingest(empty, event_log(spark, tmp_path))["user_clicks"].count() == 0
    assert counters.daily_counts(empty, F.col("action")).count() == 0
    assert counters.visits(empty).columns == ["session_id", "start", "end", "n"]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    batch, stream = actions(spark, tmp_path)
    where = str(tmp_path / "events"), str(tmp_path / "checkpoint")
    log = event_log(spark, tmp_path)
    before = streams.ingest(stream, log, *where)["user_clicks"].count()
    assert streams.ingest(stream, log, *where)["user_clicks"].count() == before == 6


class Session:
    """Stands in for a session to read settings from."""

    def __init__(self, master, root):
        self.conf = {CHECKPOINT_SETTING: root} if root else {}
        self.sparkContext = SimpleNamespace(master=master, applicationId=f"app-{master}-{root}")


def test_shared_folder():
    assert shared_dir(Session("yarn", "hdfs://x/work/")).startswith("hdfs://x/work/larder-app")
    with pytest.raises(RuntimeError):
        shared_dir(Session("yarn", None))
    local = Session("local[2]", None)
    assert shared_dir(local) == shared_dir(local)


def test_quoted_line_breaks_are_read_in_splits(spark, tmp_path):
    import csv
    import random

    rng = random.Random(4)
    signs = ["a", "é", ",", '"', "\n", " ", "\r", "x\n\ny", '""', "'"]
    folder = tmp_path / "exports"
    folder.mkdir()
    given = []
    for n in range(2):
        with open(folder / f"{n}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\r\n" if n else "\n")
            writer.writerow(RAW_RECIPES.fieldNames())
            for i in range(300):
                size = 4000 if i == 50 else 12  # one record over many splits
                row = [f"t{n}-{i}", *("v" + "".join(rng.choice(signs) for _ in range(size)) + "w"
                                      for _ in range(3))]
                writer.writerow(row)
                given.append(row)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = read_quoted_csv(spark, str(folder), RAW_RECIPES).collect()
        splits = spark.read.text(str(folder)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 20
    assert sorted(r["index"] for r in found) == list(range(600))
    assert [list(r)[:4] for r in sorted(found, key=lambda r: r["index"])] == given
    plain = src.read_raw_recipes(spark, str(folder)).count()
    assert plain == 600
    with pytest.raises(ValueError, match="header"):
        read_quoted_csv(spark, str(folder), type(RAW_RECIPES)([*RAW_RECIPES, RAW_RECIPES[0]]))


def test_quoted_csv_without_rows(spark, tmp_path):
    empty = tmp_path / "empty.csv"
    empty.write_text("Title,Instructions,Image_Name,Cleaned_Ingredients\n\n", encoding="utf-8")
    assert read_quoted_csv(spark, str(empty), RAW_RECIPES).count() == 0
