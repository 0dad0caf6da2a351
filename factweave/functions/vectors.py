"""Vectors as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalise(v: Column) -> Column:
    """v / |v| as doubles; a zero vector stays as it is."""
    return let(norm(v), lambda length: F.transform(v, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero, so that no threshold is met by accident."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
