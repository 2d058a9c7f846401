"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import materialise


def components(edges: DataFrame, label: str) -> DataFrame:
    """``id, component`` of every end of ``edges`` (a, b): the least id it reaches.

    Each round gives a node the least component among its neighbours and then
    the component of that component, so a path of n nodes takes about log n
    rounds.  Every round is written to the shared folder and only counted on the
    driver.  A node with many neighbours is summed before the exchange.
    """
    both = materialise(
        edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(),
        f"{label}-edges")
    found = materialise(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
        .select("id", F.least("id", "m").alias("component")), f"{label}-round")
    while True:
        near = both.join(found.select(F.col("id").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = found.join(near, "id").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = found.select(F.col("id").alias("component"), F.col("component").alias("far"))
        now = materialise(
            step.join(jump, "component").select(
                "id", "old", F.least("component", "far").alias("component")), f"{label}-round")
        moved = now.where("old <> component").limit(1).count()
        found = now.select("id", "component")
        if not moved:
            return found
