"""User actions fanned out to the event log.

An action has ``event_id, ts, session_id, username, recipe_title, action`` and,
for a comment, its text in ``comment``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.text import view_label

# What an action is called in the click log.
CLICK_LABELS = {"like": "Liked", "dislike": "Disliked", "comment": "Detailed Feedback",
                "bad_image": "Bad Image"}


def fan_out(actions: DataFrame) -> dict[str, DataFrame]:
    """The log rows of a batch of actions per table."""
    keyed = actions.withColumn("id", F.col("event_id").cast("string"))
    action = F.col("action")
    feedback = (F.when(action == "like", "Liked").when(action == "dislike", "Disliked")
                 .when(action == "comment", F.col("comment")))
    label = (F.when(action == "view_ingredients", view_label(F.lit("Ingredients")))
              .when(action == "view_instructions", view_label(F.lit("Instructions"))))
    for name, text in CLICK_LABELS.items():
        label = label.when(action == name, text)
    started = keyed.where(action == "login")
    return {
        # a session starts once, at its first login
        "user_sessions": started.groupBy("session_id").agg(
            F.min_by("username", "ts").alias("username"), F.min("ts").alias("ts")),
        "user_feedback": keyed.where(action.isin("like", "dislike", "comment"))
                              .withColumn("feedback", feedback)
                              .select("id", "username", "recipe_title", "feedback", "ts"),
        "user_clicks": keyed.where(action != "login").withColumn("click_type", label)
                            .select("id", "session_id", "recipe_title", "click_type", "ts"),
        "bad_image_feedback": keyed.where(action == "bad_image")
                                   .select("id", "username", "recipe_title", "ts"),
    }
