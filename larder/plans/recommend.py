"""Recommendations for a batch of requests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import adjustment_summary, image_path, numbered_text
from larder.operators.assess import assess, check_assessments, combine, fetch
from larder.operators.fulltext import TextIndex, search
from larder.operators.rewrite import gate, rewrite
from larder.session import materialise
from larder.sources.eventlog import DIRECT, EventLog

# Shown when a request has no recommendation.
REJECTED_TEXT = ("Sorry, your query doesn't seem to be a recipe request. "
                 "Please try again with a recipe-related query.")
EMPTY_TEXT = "No matching recipes found. Please try a different query."


@dataclass(frozen=True)
class Recommendations:
    retrieved: DataFrame     # query_id, rank, index, score, matched
    assessed: DataFrame      # ... title, is_relevant, reason, relevance_score
    recommended: DataFrame   # query_id, position, index, relevance_score
    rejects: DataFrame       # assessments that failed validation


def retrieve(queries: DataFrame, index: TextIndex, corpus: DataFrame, k: int = 10) -> DataFrame:
    """Search results as shown to the user."""
    found = materialise(search(queries, index, k), "retrieved")
    return fetch(found, corpus, "title", "ingredients", "instructions", "image_name").select(
        "query_id", "rank", "index", "score", "title",
        numbered_text(F.col("ingredients")).alias("ingredients"), "instructions",
        image_path(F.col("image_name")).alias("image_path"))


def recommend(queries: DataFrame, index: TextIndex, corpus: DataFrame, k: int = 10,
              max_recommendations: int = 3, min_score: int = 7,
              scorer: Callable[[DataFrame], DataFrame] = assess) -> Recommendations:
    """``queries`` has ``query_id, query, excluded_ingredients``.

    ``corpus`` has ``index, title, ingredients, text``.  ``scorer`` adds
    ``is_relevant, reason, relevance_score`` and may call a model; its result
    is written once, so it runs once.
    """
    found = materialise(search(queries, index, k), "retrieved")
    candidates = (fetch(found, corpus, "title", "ingredients", "text")
                  .join(queries.select("query_id", "query", "excluded_ingredients"), "query_id"))
    judged = scorer(candidates).select(
        "query_id", "rank", "index", "title", "is_relevant", "reason", "relevance_score")
    assessed, rejects = check_assessments(materialise(judged, "assessed"))
    return Recommendations(found, assessed,
                           combine(found, assessed, max_recommendations, min_score), rejects)


def status(requests: DataFrame, rejected: DataFrame, recommended: DataFrame) -> DataFrame:
    """One outcome per request: recommended, empty or rejected."""
    counted = recommended.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    turned_away = rejected.select("query_id", F.lit(True).alias("turned_away"))
    joined = (requests.select("query_id").join(turned_away, "query_id", "left")
              .join(counted, "query_id", "left"))
    n = F.coalesce("n", F.lit(0))
    outcome = (F.when(F.col("turned_away"), "rejected").when(n == 0, "empty")
               .otherwise("recommended"))
    return joined.select("query_id", outcome.alias("status"), n.alias("recommendations"),
                         F.when(outcome == "rejected", REJECTED_TEXT)
                          .when(outcome == "empty", EMPTY_TEXT).alias("message"))


def answer(requests: DataFrame, index: TextIndex, corpus: DataFrame,
           log: EventLog | None = None, k: int = 10, max_recommendations: int = 3,
           min_score: int = 5, scorer: Callable[[DataFrame], DataFrame] = assess,
           commit: str = DIRECT,
           rewriter: Callable[[DataFrame, DataFrame], DataFrame] = rewrite) -> tuple[DataFrame, DataFrame, Recommendations]:
    """Rewrite, gate, recommend and log; ``requests`` has ``query_id, query``.

    With a ``log`` it also has ``session_id``.  Adjustments of all requests are
    logged, queries only of those that pass the gate, as rewritten.  ``scorer`` is
    that of ``recommend``, for example a model by ``call_model``; ``commit`` names the
    batch of a stream for the log; ``rewriter`` gets the requests and the vocabulary,
    for example a model by ``rewrite_by_model``.  Returns the
    rewritten requests, their status and the recommendations.
    """
    rewritten = materialise(rewriter(requests, index.term_df), "rewritten")
    valid, rejected = gate(rewritten)
    asked = valid.select("query_id", F.col("adjusted_query").alias("query"),
                         "excluded_ingredients")
    results = recommend(asked, index, corpus, k, max_recommendations, min_score, scorer)
    recommended = materialise(results.recommended, "recommended")
    results = Recommendations(results.retrieved, results.assessed, recommended, results.rejects)
    if log is not None:
        write_log(log, requests, rewritten, results, corpus, commit)
    shown = rewritten.withColumn("summary", adjustment_summary(
        F.col("adjusted_query"), F.col("adjustments"), F.col("excluded_ingredients")))
    return shown, status(requests, rejected, recommended), results


def write_log(log: EventLog, requests: DataFrame, rewritten: DataFrame,
              results: Recommendations, corpus: DataFrame, commit: str = DIRECT) -> None:
    sessions = requests.select("query_id", "session_id")
    own = rewritten.join(sessions, "query_id")
    log.store_adjustments(own, commit)
    log.store_queries(own.where("is_recipe_request").select(
        F.col("query_id").alias("id"), "session_id", F.col("adjusted_query").alias("query")), commit)
    titled = materialise(fetch(results.retrieved, corpus, "title"), "titled").withColumnRenamed(
        "title", "recipe_title")
    titles = titled.select("query_id", "index", "recipe_title")
    log.store_retrieved(titled, commit)
    log.store_assessed(results.assessed.select(
        "query_id", F.col("title").alias("recipe_title"), "is_relevant",
        F.col("reason").alias("relevance_reason"), "relevance_score"), commit)
    log.store_recommended(results.recommended.join(titles, ["query_id", "index"], "left"), commit)
