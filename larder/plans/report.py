"""Data of the performance report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from larder.operators.metrics import score_density, score_histogram
from larder.operators.reports import feedback_bars, report_range, top_recipes


def performance_report(feedback: DataFrame, bad_images: DataFrame,
                       assessed: DataFrame) -> dict[str, DataFrame]:
    """The frames behind the report's title and panels."""
    return {
        "range": report_range(feedback, bad_images),
        "feedback": feedback_bars(feedback, bad_images),
        "score_histogram": score_histogram(assessed),
        "score_density": score_density(assessed),
        "top_liked": top_recipes(feedback, "Liked", 3),
        "top_disliked": top_recipes(feedback, "Disliked", 3),
    }
