"""Vector expressions for single query vectors; batches go through operators.nearest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """Scaled to length 1; a zero vector stays."""
    length = norm(a)
    return F.when(length > 0, F.transform(a.cast("array<double>"), lambda x: x / length)).otherwise(a.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """0 where either has length 0."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def or_zeros(a: Column, dimension: int) -> Column:
    return F.coalesce(a, F.array_repeat(F.lit(0.0).cast("float"), dimension))


def checked(a: Column, dimension: int) -> Column:
    """The vector; the query fails if one has another dimension."""
    return F.when(F.size(a) == dimension, a).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} dimensions, got "), F.size(a).cast("string"))))
