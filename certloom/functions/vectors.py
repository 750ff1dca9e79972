"""Arithmetic of vectors kept as arrays, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column, guard: float = 1e-8) -> Column:
    """The unit vector; a vector shorter than the guard is left as it is."""
    n = norm(v)
    return F.when(n < guard, v).otherwise(F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def nonzero(v: Column) -> Column:
    """Some component is not zero."""
    return F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def fused(a: Column, b: Column, weight: float) -> Column:
    """Both vectors end to end, the second weighted, at unit length."""
    return normalized(F.concat(a, F.transform(b, lambda x: x * weight)))


def or_zeros(v: Column, dim: int) -> Column:
    """The vector, or zeros where there is none."""
    return F.coalesce(v, F.array_repeat(F.lit(0.0), dim))
