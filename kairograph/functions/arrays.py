"""Vector functions over array columns, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def fit(a: Column, width: int) -> Column:
    """Cut or zero-padded to a width."""
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), width)), 1, width)


def argmax(a: Column) -> Column:
    """Index of the first largest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


def minmax_scaled(value: Column, low: Column, high: Column) -> Column:
    """To [-1, 1] between two bounds; 0 if they are equal."""
    return F.when(high > low, (value - low) / (high - low) * 2 - 1).otherwise(0.0)


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def time_encoding(delta: Column, width: int) -> Column:
    """Cosines of a time difference at ``width`` geometric frequencies."""
    return F.array(*[F.cos(delta * (10.0 ** (-9.0 * i / max(1, width - 1)))) for i in range(width)])
