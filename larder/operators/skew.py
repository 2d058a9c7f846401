"""Joining a skewed table to one with unique keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import materialise

# A key is hot when it holds more than this share of the rows; there can be
# at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                share: float = HOT_SHARE, counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined to ``right``, whose ``key`` is unique.

    Rows of the hot keys stay where they are and meet a broadcast of at most
    ``1 / share`` right rows; only the other rows are shuffled.  ``counts``
    gives the rows ``n`` per key of ``left`` where they are known already.
    """
    if counts is None:
        counts = materialise(left.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(
        counts.where((F.col("n") > share * total) & F.col(key).isNotNull()).select(key))
    common = left.join(hot, key, "left_semi").join(
        F.broadcast(right.join(hot, key, "left_semi")), key, how)
    rest = left.join(hot, key, "left_anti").join(right, key, how)
    return common.unionByName(rest)
