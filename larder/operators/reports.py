"""Feedback and score aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import day_text


def _share(condition: Column, name: str) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).alias(name)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Totals; on an empty log the count is 0 and the sums are null."""
    kind = F.col("feedback")
    return feedback.agg(
        F.count(F.lit(1)).alias("total_feedback"), _share(kind == "Liked", "likes"),
        _share(kind == "Disliked", "dislikes"),
        _share(~kind.isin("Liked", "Disliked"), "detailed_feedback"))


def like_totals(feedback: DataFrame) -> DataFrame:
    return feedback.agg(_share(F.col("feedback") == "Liked", "likes"),
                        _share(F.col("feedback") == "Disliked", "dislikes"))


def bad_image_count(bad_images: DataFrame) -> DataFrame:
    return bad_images.agg(F.count(F.lit(1)).alias("bad_image_reports"))


def feedback_bars(feedback: DataFrame, bad_images: DataFrame) -> DataFrame:
    """``metric, count`` for likes, dislikes and bad-image reports."""
    likes = like_totals(feedback).selectExpr(
        "stack(2, 'Likes', likes, 'Dislikes', dislikes) as (metric, count)")
    images = bad_image_count(bad_images).select(
        F.lit("Bad Image Reports").alias("metric"), F.col("bad_image_reports").alias("count"))
    return likes.unionByName(images)


def top_recipes(feedback: DataFrame, kind: str = "Liked", n: int = 10) -> DataFrame:
    """Most often liked (or disliked) recipes; equal counts by title."""
    return (feedback.where(F.col("feedback") == kind).groupBy("recipe_title")
            .agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), F.asc("recipe_title")).limit(n))


def report_range(feedback: DataFrame, bad_images: DataFrame) -> DataFrame:
    """First and last day over both logs; null when both are empty."""
    times = feedback.select("ts").unionByName(bad_images.select("ts"))
    return times.agg(day_text(F.min("ts")).alias("start_date"),
                     day_text(F.max("ts")).alias("end_date"))
