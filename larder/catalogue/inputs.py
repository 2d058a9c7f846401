"""The given tables mapped to the package's inputs.

Stored indexes and other written results are built once per session and table
folder, as a service would keep them, and shared by the queries that read them.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.operators.embed import hashed_vectors
from larder.operators.fulltext import TextIndex, build_index, term_counts
from larder.operators.neighbours import VectorIndex, build_vector_index
from larder.plans.compare import Comparison, compare
from larder.plans.feedback import fan_out
from larder.plans.ingest import prepare
from larder.plans.recommend import answer
from larder.session import materialise, materialise_bucketed, spread
from larder.sources.recipes import number_rows

_kept: dict[tuple, Any] = {}


def keep(spark: SparkSession, sf: str, name: str, build: Callable[[], Any]) -> Any:
    at = (spark.sparkContext.applicationId, sf, name)
    if at not in _kept:
        _kept[at] = build()
    return _kept[at]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Search corpus and queries

def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("index"), "text")


def passages(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def turns(spark, sf) -> DataFrame:
    """What users said, keyed by conversation and turn."""
    said = table(spark, sf, "conversations").where(F.col("role") == "user")
    return said.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
        .alias("query_id"),
        F.col("text").alias("query"),
        F.expr("cast(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval("
               "0, cast(conv_id as int), cast(turn as int), 0) as timestamp)").alias("ts"))


def document_index(spark, sf) -> TextIndex:
    return keep(spark, sf, "document-index", lambda: build_index(documents(spark, sf)))


def document_vectors(spark, sf) -> VectorIndex:
    return keep(spark, sf, "document-vectors", lambda: build_vector_index(materialise(
        hashed_vectors(document_index(spark, sf).docs), "vectors")))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("index"), F.col("embedding").alias("vec"))


def comparison(spark, sf) -> Comparison:
    return keep(spark, sf, "comparison", lambda: compare(documents(spark, sf)))


# Recipes

def _as_recipe(parts: DataFrame, index) -> DataFrame:
    name, kind, brand = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    listed = F.concat(F.lit("['"), brand, F.lit("', '"), kind, F.lit("', '"), kind, F.lit(" "),
                      name, F.lit("']"))
    return parts.select(
        index.alias("index"), name.alias("title"), listed.alias("cleaned_ingredients"),
        kind.alias("instructions"), F.col("p_partkey").cast("string").alias("image_name"))


def raw_recipes(spark, sf) -> DataFrame:
    """Recipes numbered by their place in the file."""
    return _as_recipe(number_rows(table(spark, sf, "part"), "row"), F.col("row"))


def recipes(spark, sf) -> DataFrame:
    """Processed recipes keyed by part."""
    parts = spread(table(spark, sf, "part"), "p_partkey")
    return prepare(_as_recipe(parts, F.col("p_partkey")))[0].withColumn(
        "text", F.col("text_for_search"))


def stored_recipes(spark, sf) -> DataFrame:
    return keep(spark, sf, "recipes", lambda: materialise_bucketed(
        recipes(spark, sf), "recipes", "index",
        int(spark.conf.get("spark.sql.shuffle.partitions"))))


def recipe_index(spark, sf) -> TextIndex:
    return keep(spark, sf, "recipe-index",
                lambda: build_index(stored_recipes(spark, sf)))


def requests(spark, sf) -> DataFrame:
    """Requests with exclusions, misspelt requests and talk about other things."""
    part = table(spark, sf, "part")
    name = F.col("p_name")
    asked = part.select(F.concat(name, F.lit(" without "), F.lower("p_type")).alias("query"))
    misspelt = part.select(
        F.concat(F.substring(name, 1, 2), F.expr("substr(p_name, 4)")).alias("query"))
    talk = turns(spark, sf).select("query")
    return (asked.union(misspelt).union(talk).distinct()
            .select(F.md5("query").alias("query_id"), "query"))


def answers(spark, sf):
    """Rewritten requests, their status and the recommendations."""
    return keep(spark, sf, "answers", lambda: answer(
        materialise(requests(spark, sf), "requests"), recipe_index(spark, sf),
        stored_recipes(spark, sf)))


def document_corpus(spark, sf) -> DataFrame:
    """Documents as recipes whose ingredients are their distinct terms."""
    counted = term_counts(documents(spark, sf))
    return counted.join(documents(spark, sf), "index").select(
        "index", F.col("index").cast("string").alias("title"), "text",
        F.transform("terms", lambda t: t["term"]).alias("ingredients"))


# Event log

def actions(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    action = (F.when(kind == "signup", "login").when(kind == "purchase", "like")
               .when(kind == "error", "dislike").when(kind == "click", "comment")
               .when(F.col("value") > 50, "bad_image").otherwise("view_ingredients"))
    user = F.col("user_id").cast("string")
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), user.alias("session_id"),
        user.alias("username"), F.get_json_object("props", "$.k").alias("recipe_title"),
        action.alias("action"), F.col("props").alias("comment"))


def log(spark, sf) -> dict[str, DataFrame]:
    return fan_out(actions(table(spark, sf, "events")))


def sessions(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("session_id"), F.col("c_name").alias("username"))


def user_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_custkey").cast("string").alias("session_id"),
        F.col("o_orderpriority").alias("query"),
        F.col("o_orderdate").cast("timestamp").alias("ts"))


def assessments(spark, sf) -> DataFrame:
    """Assessments taken from the labels; unlabelled documents have no score."""
    labels = table(spark, sf, "labels")
    score = 5 * F.col("quality") + F.when(F.col("toxic") == 0, 3).otherwise(0) + F.col("index") % 3
    long_text = F.when(F.length("text") > 5000, 4).otherwise(0)
    return (documents(spark, sf).join(labels.withColumnRenamed("doc_id", "index"), "index", "left")
            .select("index", F.col("index").cast("string").alias("title"),
                    (F.col("quality") == 1).alias("is_relevant"),
                    F.when(F.col("quality").isNotNull(), "label").alias("reason"),
                    (score + long_text).cast("int").alias("relevance_score"),
                    score.cast("int").alias("label_score")))
