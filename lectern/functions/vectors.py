"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """The vector over its length; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a))).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def with_position(a: Column, position: Column, count: Column, weight: float = 0.15) -> Column:
    """The vector with its place in the sequence, from 0 to ``weight``, as one more number."""
    return F.concat(F.transform(a, lambda x: x.cast("double")), F.array(F.coalesce(F.try_divide(position, count - 1), F.lit(0.0)) * weight))
