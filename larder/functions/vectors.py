"""Column expressions over vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    def squared(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap
    return F.sqrt(_total(F.zip_with(a, b, squared)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def single_precision(a: Column) -> Column:
    """Spark has no half-precision type; single precision is the narrowest."""
    return a.cast("array<float>")
