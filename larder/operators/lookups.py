"""Reads of the event log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import adjustment_digest, time_text
from larder.operators.skew import join_unique

NEWEST = (F.desc, "ts"), (F.desc, "id")


def _newest() -> list[Column]:
    return [order(column) for order, column in NEWEST]


def feedback_by_user(feedback: DataFrame, username: Column | str) -> DataFrame:
    return feedback.where(F.col("username") == username)


def feedback_by_recipe(feedback: DataFrame, recipe_title: Column | str) -> DataFrame:
    return feedback.where(F.col("recipe_title") == recipe_title)


def user_queries(queries: DataFrame, sessions: DataFrame, session_id: str | None = None,
                 username: str | None = None) -> DataFrame:
    """Newest first; a session, if given, wins over a user name."""
    if session_id is not None:
        queries = queries.where(F.col("session_id") == session_id)
    elif username is not None:
        own = sessions.where(F.col("username") == username).select("session_id").distinct()
        queries = queries.join(own, "session_id", "left_semi").select(*queries.columns)
    return queries.orderBy(*_newest())


def queries_with_user(queries: DataFrame, sessions: DataFrame) -> DataFrame:
    """Every query with the user of its session."""
    return join_unique(queries, sessions.select("session_id", "username"), "session_id")


def user_clicks(clicks: DataFrame, session_id: str | None = None) -> DataFrame:
    if session_id is not None:
        clicks = clicks.where(F.col("session_id") == session_id)
    return clicks.orderBy(*_newest())


def recent_adjustments(adjustments: DataFrame, limit: int = 10) -> DataFrame:
    """The newest adjustments and their text for the page."""
    return (adjustments.orderBy(*_newest()).limit(limit)
            .withColumn("digest", adjustment_digest(
                time_text(F.col("ts")), F.col("original_query"), F.col("adjusted_query"),
                F.col("excluded_ingredients"))))


def query_trace(queries: DataFrame, retrieved: DataFrame, assessed: DataFrame,
                recommended: DataFrame) -> DataFrame:
    """What happened to every query, one row per step.

    ``stage`` is query, retrieved, assessed or recommended.  A query without
    results has its query row alone.  Lists stay rows, so a query with very
    many of them is never held in one place.
    """
    def rows(df: DataFrame, stage: str, place: Column, recipe: Column, score: Column) -> DataFrame:
        return df.select(
            "query_id", F.lit(stage).alias("stage"), place.cast("int").alias("place"),
            recipe.cast("string").alias("recipe"), score.cast("double").alias("score"))
    none = F.lit(None)
    return reduce(DataFrame.unionByName, [
        rows(queries, "query", none, none, none),
        rows(retrieved, "retrieved", F.col("rank"), F.col("index"), F.col("score")),
        rows(assessed, "assessed", F.col("rank"), F.col("index"), F.col("relevance_score")),
        rows(recommended, "recommended", F.col("position"), F.col("index"),
             F.col("relevance_score"))])


def trace_of(query_id, queries: DataFrame, retrieved: DataFrame, assessed: DataFrame,
             recommended: DataFrame) -> dict[str, DataFrame]:
    """The four frames of one query; filters reach the scans."""
    frames = dict(query=queries, retrieved_recipes=retrieved, assessed_recipes=assessed,
                  recommended_recipes=recommended)
    return {name: df.where(F.col("query_id") == query_id) for name, df in frames.items()}


def session_activity(sessions: DataFrame, queries: DataFrame, clicks: DataFrame) -> DataFrame:
    """First and last activity per session.

    Starting, asking and giving feedback are activity; viewing details is not.
    """
    acting = clicks.where(~F.col("click_type").startswith("View"))
    seen = reduce(DataFrame.unionByName, [
        df.select("session_id", "ts") for df in (sessions, queries, acting)])
    return seen.groupBy("session_id").agg(
        F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"),
        F.count(F.lit(1)).alias("actions"))
