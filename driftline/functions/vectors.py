"""Vector expressions over ARRAY columns; arithmetic is always in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9  # fixed value: guard of the cosine and z-score denominators


def doubles(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def total(v: Column | str) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def scaled(v: Column | str, by: Column) -> Column:
    """Every component divided by one number per row.

    A lambda body is evaluated per element, so the number is spread to an array first and computed once per row.
    """
    return F.zip_with(doubles(v), F.array_repeat(by, F.size(doubles(v))), lambda x, s: x / s)


def unit(v: Column | str) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    size = norm(v)
    return scaled(v, F.when(size == 0, F.lit(1.0)).otherwise(size))


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(EPS))
