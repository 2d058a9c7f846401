"""Consistency checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.schemas import FOREIGN_KEYS


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values without a parent row, with their number of child rows.

    The child is counted per key first, so a frequent key crosses the network
    once per task.
    """
    counted = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("child_rows"))
    return counted.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def audit(links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Orphans of several foreign keys in one table."""
    return reduce(DataFrame.unionByName, [
        orphans(*link).select(F.lit(name).alias("link"), F.col("key").cast("string").alias("key"),
                              "child_rows")
        for name, link in links.items()])


def log_audit(read: Callable[[str], DataFrame]) -> DataFrame:
    """Orphans of the declared keys of the event log; ``read`` gives a table by name."""
    return audit({f"{child}.{key}": (read(child), key, read(parent), parent_key)
                  for child, key, parent, parent_key in FOREIGN_KEYS})


def missing_images(recipes: DataFrame, listing: DataFrame, path: str = "image_path") -> DataFrame:
    """Recipes whose image path is not in the listing."""
    return recipes.join(listing.select(F.col("path").alias(path)), path, "left_anti")
