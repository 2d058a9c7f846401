"""The registered queries: each takes a session and a table folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.catalogue import inputs as src
from larder.functions.text import (
    image_path, list_to_json, numbered_text, parse_list_text, time_text)
from larder.operators import assess as judging
from larder.operators import audit, lookups, reports, rewrite
from larder.operators.approximate import approximate_knn, build_approximate, recall_at
from larder.operators.embed import hashed_vectors
from larder.operators.fulltext import build_index, corpus_stats, search
from larder.operators.hybrid import hybrid_search
from larder.operators.neighbours import build_vectors, knn
from larder.operators.prompts import known_item_prompts, negation_prompts, prompt_rows
from larder.operators.sampling import sample_rows
from larder.operators.skew import join_unique
from larder.plans.ingest import ingest as ingest_recipes
from larder.plans.ingest import prepare
from larder.plans.recommend import recommend, retrieve
from larder.plans.report import performance_report
from larder.session import materialise
from larder.sources.eventlog import EventLog
from larder.streaming import counters
from larder.streaming.ingest import deduplicated, ingest, read_stream
from larder.streaming.recommend import recommend_stream
from larder.session import work_path

DIM = 64


# Ingest

def ingest_search_text(spark, sf) -> DataFrame:
    processed, _ = prepare(src.raw_recipes(spark, sf))
    return processed.select("index", "title", "text_for_search", "text_for_embedding",
                            F.size("ingredients").alias("n_ingredients"), "has_gaps")


def ingest_csv(spark, sf) -> DataFrame:
    """The recipes by way of an export whose instructions hold line breaks and quotes."""
    export, corpus = work_path(spark, "export"), work_path(spark, "corpus")
    raw = src.raw_recipes(spark, sf).select(
        F.col("title").alias("Title"),
        F.concat("instructions", F.lit('\n\n"Serve",\nwarm.')).alias("Instructions"),
        F.col("image_name").alias("Image_Name"),
        F.col("cleaned_ingredients").alias("Cleaned_Ingredients"))
    raw.write.option("header", True).option("escape", '"').csv(export)
    processed, _ = ingest_recipes(spark, export, corpus)
    return processed.select("title", "text_for_search", F.size("ingredients").alias("n_ingredients"))


def ingredients_numbered(spark, sf) -> DataFrame:
    return src.recipes(spark, sf).select(
        "index", numbered_text(F.col("ingredients")).alias("numbered"),
        image_path(F.col("image_name")).alias("image_path"))


def list_text_quarantine(spark, sf) -> DataFrame:
    """The dialects of list text a recipe table holds, by size of the part."""
    brand, kind, size = F.col("p_brand"), F.col("p_type"), F.col("p_size")

    def text(*pieces):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])
    written = (F.when(size <= 10, text("['", brand, "', '", kind, "']"))
               .when(size <= 18, text("[\"", brand, "'s\", '", kind, "']"))
               .when(size <= 24, text("['", brand, "\\'s \"best\"', '", kind, "']"))
               .when(size <= 30, text("['\\xbd ", brand, "', 'caf\\u00e9 ", kind, "']"))
               .when(size <= 35, text("['", brand, "', None]"))
               .when(size <= 40, F.lit("nan"))
               .when(size <= 45, text("['", brand, "',]"))
               .otherwise("[]"))
    parsed = src.table(spark, sf, "part").select(
        "p_partkey", written.alias("written")).withColumn(
        "items", parse_list_text(F.col("written")))
    return parsed.select(
        "p_partkey", "written", F.array_join("items", "|").alias("items"),
        F.when(F.col("items").isNull(), "rejected").otherwise("ok").alias("status"))


# Search

def fts_index_stats(spark, sf) -> DataFrame:
    return corpus_stats(src.document_index(spark, sf).docs).withColumn(
        "avg_len", F.round("avg_len", 6))


def fts_postings(spark, sf) -> DataFrame:
    index = src.document_index(spark, sf)
    # lists travel, a few rows per block for a frequent term, and are unpacked behind the join
    return index.blocks.join(index.term_df, "term").select(
        "term", "df", F.explode("entries").alias("entry")).select(
        "term", "entry.index", "entry.tf", "entry.doc_len", "df")


def fts_top10(spark, sf) -> DataFrame:
    return search(src.passages(spark, sf), src.document_index(spark, sf), 10)


def fts_turns_top10(spark, sf) -> DataFrame:
    return search(src.turns(spark, sf), src.document_index(spark, sf), 10)


def fts_pruned_top10(spark, sf) -> DataFrame:
    """With floors from a part of the blocks, as over large tables."""
    index = src.keep(spark, sf, "fine-index", lambda: build_index(
        src.documents(spark, sf), block_docs=64))
    return search(src.passages(spark, sf), index, 10, sample_one_in=4)


def retrieve_recipes(spark, sf) -> DataFrame:
    names = src.table(spark, sf, "part").select(F.col("p_name").alias("query")).distinct()
    return retrieve(names.withColumn("query_id", F.col("query")), src.recipe_index(spark, sf),
                    src.stored_recipes(spark, sf), 10)


def _knn(spark, sf, metric: str) -> DataFrame:
    vectors, _ = build_vectors(src.vectors(spark, sf), DIM)
    return knn(vectors.withColumnRenamed("index", "query_id"), vectors, 5, metric)


def knn_l2_top5(spark, sf) -> DataFrame:
    return _knn(spark, sf, "l2")


def knn_cosine_top5(spark, sf) -> DataFrame:
    return _knn(spark, sf, "cosine")


def knn_dot_top5(spark, sf) -> DataFrame:
    return _knn(spark, sf, "dot")


def _approximate(spark, sf) -> DataFrame:
    vectors, _ = build_vectors(src.vectors(spark, sf), DIM)
    index = src.keep(spark, sf, "approximate-index", lambda: build_approximate(vectors, "cosine"))
    return approximate_knn(vectors.withColumnRenamed("index", "query_id"), index, 5)


def knn_approximate_top5(spark, sf) -> DataFrame:
    return _approximate(spark, sf)


def knn_approximate_recall(spark, sf) -> DataFrame:
    """Whether the approximate search finds 0.9 of the exact neighbours by cosine."""
    found = recall_at(_approximate(spark, sf), _knn(spark, sf, "cosine"))
    return found.select("n_true", (F.col("recall") >= 0.9).alias("reached"))


def embed_hashed(spark, sf) -> DataFrame:
    vectors = hashed_vectors(src.document_index(spark, sf).docs)
    # the outer form keeps Spark from building every vector once more to see that it has entries
    return vectors.select("index", F.posexplode_outer("vec").alias("bucket", "weight")).select(
        "index", "bucket", (F.round(F.col("weight").cast("double"), 5) + 0.0).alias("weight"))


def hybrid_rrf_top5(spark, sf) -> DataFrame:
    return hybrid_search(src.passages(spark, sf), src.document_index(spark, sf),
                         src.document_vectors(spark, sf), 5)


def eval_results(spark, sf) -> DataFrame:
    return src.comparison(spark, sf).results.select("method", "query_id", "rank", "index")


def eval_methods(spark, sf) -> DataFrame:
    return src.comparison(spark, sf).metrics()


def eval_best(spark, sf) -> DataFrame:
    return src.comparison(spark, sf).best()


# Samples and prompts

def sample_seeded(spark, sf) -> DataFrame:
    """Prompts of a sample of the documents that have terms, joined to the documents."""
    index = src.document_index(spark, sf)
    keys = materialise(sample_rows(index.docs.where(F.size("terms") > 0).select("index"), 200,
                                   strict=False), "sample")
    sample = known_item_prompts(index, keys)
    docs = src.table(spark, sf, "documents").withColumnRenamed("doc_id", "index")
    return docs.join(sample, "index").select(
        "index", "n_chars", list_to_json(F.col("prompts")).alias("prompts"))


def prompts_known_item(spark, sf) -> DataFrame:
    return prompt_rows(known_item_prompts(src.document_index(spark, sf)))


def prompts_negation(spark, sf) -> DataFrame:
    return prompt_rows(negation_prompts(src.document_index(spark, sf)))


# Rewriting

def rewrite_negation(spark, sf) -> DataFrame:
    split = rewrite.split_exclusions(src.requests(spark, sf))
    return split.select("query_id", F.array_join("kept", " ").alias("kept"),
                        F.array_join("excluded_ingredients", "|").alias("excluded"))


def rewrite_spelling(spark, sf) -> DataFrame:
    words = src.turns(spark, sf).select(F.explode(
        rewrite.kept_terms(rewrite.mark_clauses(F.col("query")))).alias("term"))
    return rewrite.look_up(words, src.document_index(spark, sf).term_df).select(
        "term", "known", "fix")


def _rewritten(df: DataFrame, *more: str) -> DataFrame:
    return df.select(
        "query_id", "is_recipe_request", "adjusted_query",
        F.array_join("excluded_ingredients", "|").alias("excluded"),
        F.array_join("adjustments", "|").alias("adjustments"), "reasoning", *more)


def rewrite_model(spark, sf) -> DataFrame:
    """Requests answered by a callable that knows one word of exclusion and rejects the rest."""
    def call(batch):
        parts = batch["query"].str.split(" without ", n=1, expand=True).reindex(columns=[0, 1])
        return batch[["query_id"]].assign(
            is_recipe_request=True, original_query=batch["query"], adjusted_query=parts[0],
            excluded_ingredients=[[e] for e in parts[1]],
            adjustments=[[f"Excluded {e}"] for e in parts[1]], reasoning="one exclusion",
            error=parts[1].isna().map({True: "no exclusion", False: None}))

    answered = rewrite.rewrite_by_model(
        src.requests(spark, sf), call, src.recipe_index(spark, sf).term_df, wait=0.0,
        store=work_path(spark, "answers"))
    return _rewritten(answered, "answered_by")


def rewrite_gate(spark, sf) -> DataFrame:
    return _rewritten(rewrite.rewrite(
        src.passages(spark, sf), src.document_index(spark, sf).term_df))


def rewrite_requests(spark, sf) -> DataFrame:
    return _rewritten(src.answers(spark, sf)[0]).join(
        src.answers(spark, sf)[0].select("query_id", "summary"), "query_id")


# Assessment and recommendation

def _document_results(spark, sf):
    """Passages with an exclusion, answered from the documents."""
    def build():
        asked = rewrite.split_exclusions(src.passages(spark, sf)).select(
            "query_id", F.array_join("kept", " ").alias("query"),
            F.array_union("excluded_ingredients", F.slice("kept", 1, 1))
            .alias("excluded_ingredients"))
        return recommend(materialise(asked, "asked"), src.document_index(spark, sf),
                         src.document_corpus(spark, sf), min_score=5)
    return src.keep(spark, sf, "document-results", build)


def assess_score(spark, sf) -> DataFrame:
    return _document_results(spark, sf).assessed.select(
        "query_id", "index", "relevance_score", "is_relevant")


def recommend_documents(spark, sf) -> DataFrame:
    return _document_results(spark, sf).recommended


def _candidates(spark, sf) -> DataFrame:
    rewritten, _, results = src.answers(spark, sf)
    asked = rewritten.select("query_id", F.col("adjusted_query").alias("query"),
                             "excluded_ingredients")
    return judging.fetch(results.retrieved, src.stored_recipes(spark, sf), "title", "ingredients",
                         "instructions").join(asked, "query_id")


def assess_requests(spark, sf) -> DataFrame:
    return src.answers(spark, sf)[2].assessed.select(
        "query_id", "index", "title", "is_relevant", "reason", "relevance_score")


def exclusion_hits(spark, sf) -> DataFrame:
    return judging.exclusion_hits(_candidates(spark, sf).select(
        "query_id", "index", "ingredients", "excluded_ingredients"))


def assess_prompt(spark, sf) -> DataFrame:
    return judging.judge_prompts(_candidates(spark, sf))


def assessment_check(spark, sf) -> DataFrame:
    valid, rejects = judging.check_assessments(src.assessments(spark, sf))
    columns = ("index", "relevance_score")
    return valid.select(*columns, F.lit("valid").alias("verdict")).unionByName(
        rejects.select(*columns, F.col("reject_reason").alias("verdict")))


def combine_labels(spark, sf) -> DataFrame:
    """Search results filtered and ordered by assessments made elsewhere."""
    found = materialise(fts_turns_top10(spark, sf), "found")
    judged = src.assessments(spark, sf).select(
        "index", "is_relevant", F.col("label_score").alias("relevance_score"))
    keyed = join_unique(found.select("query_id", "index"), judged, "index")
    return judging.combine(found, keyed, 3, 7)


def recommend_top3(spark, sf) -> DataFrame:
    return src.answers(spark, sf)[2].recommended


def recommend_status(spark, sf) -> DataFrame:
    return src.answers(spark, sf)[1]


def query_trace(spark, sf) -> DataFrame:
    rewritten, _, results = src.answers(spark, sf)
    return lookups.query_trace(rewritten.where("is_recipe_request"), results.retrieved,
                               results.assessed, results.recommended)


# Event log and report

def feedback_stats(spark, sf) -> DataFrame:
    return reports.feedback_stats(src.log(spark, sf)["user_feedback"])


def feedback_totals(spark, sf) -> DataFrame:
    return reports.like_totals(src.log(spark, sf)["user_feedback"])


def feedback_bars(spark, sf) -> DataFrame:
    log = src.log(spark, sf)
    return reports.feedback_bars(log["user_feedback"], log["bad_image_feedback"])


def bad_images(spark, sf) -> DataFrame:
    return reports.bad_image_count(src.log(spark, sf)["bad_image_feedback"])


def most_liked(spark, sf) -> DataFrame:
    return reports.top_recipes(src.log(spark, sf)["user_feedback"], "Liked", 10)


def _report(spark, sf) -> dict[str, DataFrame]:
    log = src.log(spark, sf)
    scores = src.assessments(spark, sf).select(F.col("label_score").alias("relevance_score"))
    return performance_report(log["user_feedback"], log["bad_image_feedback"], scores)


def top_liked(spark, sf) -> DataFrame:
    return _report(spark, sf)["top_liked"]


def top_disliked(spark, sf) -> DataFrame:
    return _report(spark, sf)["top_disliked"]


def report_range(spark, sf) -> DataFrame:
    return _report(spark, sf)["range"]


def score_hist(spark, sf) -> DataFrame:
    return _report(spark, sf)["score_histogram"]


def score_kde(spark, sf) -> DataFrame:
    return _report(spark, sf)["score_density"]


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", time_text(F.col("ts")))


def all_feedback(spark, sf) -> DataFrame:
    return _timed(src.log(spark, sf)["user_feedback"])


def _most_frequent(df: DataFrame, column: str):
    return (df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(column)).first()[column])


def feedback_by_user(spark, sf) -> DataFrame:
    """Feedback of the user who gave most."""
    feedback = src.log(spark, sf)["user_feedback"]
    return _timed(lookups.feedback_by_user(feedback, _most_frequent(feedback, "username")))


def feedback_by_recipe(spark, sf) -> DataFrame:
    feedback = src.log(spark, sf)["user_feedback"]
    return _timed(lookups.feedback_by_recipe(feedback, _most_frequent(feedback, "recipe_title")))


def clicks(spark, sf) -> DataFrame:
    return _timed(lookups.user_clicks(src.log(spark, sf)["user_clicks"]))


def clicks_by_session(spark, sf) -> DataFrame:
    clicked = src.log(spark, sf)["user_clicks"]
    return _timed(lookups.user_clicks(clicked, _most_frequent(clicked, "session_id")))


def click_counts(spark, sf) -> DataFrame:
    return src.log(spark, sf)["user_clicks"].groupBy("click_type").agg(
        F.count(F.lit(1)).alias("n"))


def user_queries(spark, sf) -> DataFrame:
    """All queries with their user."""
    return _timed(lookups.queries_with_user(src.user_queries(spark, sf), src.sessions(spark, sf)))


def user_queries_by_session(spark, sf) -> DataFrame:
    queries = src.user_queries(spark, sf)
    return _timed(lookups.user_queries(queries, src.sessions(spark, sf),
                                       session_id=_most_frequent(queries, "session_id")))


def user_queries_by_name(spark, sf) -> DataFrame:
    queries, sessions = src.user_queries(spark, sf), src.sessions(spark, sf)
    name = _most_frequent(lookups.queries_with_user(queries, sessions), "username")
    return _timed(lookups.user_queries(queries, sessions, username=name))


def recent_adjustments(spark, sf) -> DataFrame:
    said = src.turns(spark, sf)
    rewritten = rewrite.rewrite(said, src.document_index(spark, sf).term_df)
    logged = rewritten.join(said.select("query_id", "ts"), "query_id").withColumnRenamed(
        "query_id", "id")
    recent = lookups.recent_adjustments(logged, 10)
    return _timed(recent).select(
        "id", "ts", "original_query", "adjusted_query",
        list_to_json(F.col("excluded_ingredients")).alias("excluded_ingredients"), "digest")


def session_activity(spark, sf) -> DataFrame:
    log = session_log(spark, sf)
    seen = lookups.session_activity(
        log["user_sessions"], log["user_queries"], log["user_clicks"])
    return seen.select("session_id", time_text(F.col("first_activity")).alias("first_activity"),
                       time_text(F.col("last_activity")).alias("last_activity"), "actions")


def session_log(spark, sf) -> dict[str, DataFrame]:
    """Sessions, queries and clicks of the given tables as tables of the event log."""
    queries = src.user_queries(spark, sf)
    return {**src.log(spark, sf), "user_queries": queries}


def log_key_audit(spark, sf) -> DataFrame:
    """The six declared keys of the log, its results taken from other tables."""
    def keyed(name: str, column: str, key: str) -> DataFrame:
        return src.table(spark, sf, name).select(F.col(column).cast("string").alias(key))

    tables = {**session_log(spark, sf),
              "query_adjustments": keyed("conversations", "conv_id", "session_id"),
              "retrieved_recipes": keyed("lineitem", "l_orderkey", "query_id"),
              "assessed_recipes": keyed("labels", "doc_id", "query_id"),
              "recommended_recipes": keyed("benchmark", "item_id", "query_id")}
    return audit.log_audit(tables.__getitem__)


def orphan_audit(spark, sf) -> DataFrame:
    table = lambda name: src.table(spark, sf, name)
    return audit.audit({
        "orders.o_custkey": (table("orders"), "o_custkey", table("customer"), "c_custkey"),
        "labels.doc_id": (table("labels"), "doc_id", table("pages"), "page_id"),
        "customer.c_custkey": (table("customer"), "c_custkey", table("orders"), "o_custkey"),
        "events.user_id": (table("events"), "user_id", table("supplier"), "s_suppkey"),
    })


def missing_images(spark, sf) -> DataFrame:
    named = src.recipes(spark, sf).select(
        "index", "title", image_path(F.col("image_name")).alias("image_path"))
    listing = src.table(spark, sf, "pages").select(
        image_path(F.col("page_id").cast("string")).alias("path"))
    return audit.missing_images(named, listing)


# Streams

def _event_stream(spark, sf) -> DataFrame:
    schema = src.table(spark, sf, "events").schema
    return read_stream(spark, f"{sf}/events.parquet", schema)


def stream_feedback_daily(spark, sf) -> DataFrame:
    return counters.daily_counts(src.actions(_event_stream(spark, sf)), F.col("action"))


def stream_sessions(spark, sf) -> DataFrame:
    seen = counters.sessions(src.actions(_event_stream(spark, sf)))
    return seen.select("session_id", time_text(F.col("first_ts")).alias("first_ts"),
                       time_text(F.col("last_ts")).alias("last_ts"), "n")


def stream_visits(spark, sf) -> DataFrame:
    seen = counters.visits(src.actions(_event_stream(spark, sf)))
    return seen.select("session_id", time_text(F.col("start")).alias("start"),
                       time_text(F.col("end")).alias("end"), "n")


def stream_dedup(spark, sf) -> DataFrame:
    """Every event delivered twice, kept once."""
    doubled = _event_stream(spark, sf).unionByName(_event_stream(spark, sf))
    return deduplicated(doubled, work_path(spark, "deduped")).select(
        "event_id", time_text(F.col("ts")).alias("ts"), "user_id", "event_type", "props")


def _event_log(spark) -> EventLog:
    path = work_path(spark, "log")
    return EventLog(spark, "larder_" + path.rsplit("-", 1)[1], path)


def stream_log(spark, sf) -> DataFrame:
    """Rows and last time per log table written by the ingest stream."""
    tables = ingest(src.actions(_event_stream(spark, sf)), _event_log(spark))
    counted = [df.agg(F.count(F.lit(1)).alias("n"), time_text(F.max("ts")).alias("last_ts"))
               .select(F.lit(name).alias("log_table"), "n", "last_ts")
               for name, df in tables.items()]
    stacked = counted[0]
    for other in counted[1:]:
        stacked = stacked.unionByName(other)
    return stacked


def stream_recommend(spark, sf) -> DataFrame:
    """The requests as a stream; the same answers as for the batch."""
    folder = work_path(spark, "request-stream")
    src.requests(spark, sf).write.parquet(folder)
    schema = T.StructType().add("query_id", "string").add("query", "string")
    recommended, _ = recommend_stream(
        read_stream(spark, folder, schema), src.recipe_index(spark, sf),
        src.stored_recipes(spark, sf))
    return recommended.select("query_id", "position", "index", "relevance_score")


QUERIES = {f.__name__: f for f in (
    fts_top10, fts_index_stats, fts_postings, fts_turns_top10, fts_pruned_top10, retrieve_recipes,
    ingest_search_text, ingest_csv, ingredients_numbered, list_text_quarantine,
    knn_l2_top5, knn_cosine_top5, knn_dot_top5, knn_approximate_top5,
    knn_approximate_recall, embed_hashed, hybrid_rrf_top5,
    eval_results, eval_methods, eval_best,
    sample_seeded, prompts_known_item, prompts_negation,
    rewrite_negation, rewrite_spelling, rewrite_model, rewrite_gate, rewrite_requests,
    assess_score, recommend_documents, assess_requests, exclusion_hits, assess_prompt,
    assessment_check, combine_labels, recommend_top3, recommend_status, query_trace,
    feedback_stats, feedback_totals, feedback_bars, bad_images, most_liked, top_liked,
    top_disliked, report_range, score_hist, score_kde,
    all_feedback, feedback_by_user, feedback_by_recipe, clicks, clicks_by_session, click_counts,
    user_queries, user_queries_by_session, user_queries_by_name, recent_adjustments,
    session_activity, orphan_audit, log_key_audit, missing_images,
    stream_feedback_daily, stream_sessions, stream_visits, stream_dedup, stream_log,
    stream_recommend,
)}
