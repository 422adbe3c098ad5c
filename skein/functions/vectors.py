"""Arrays of numbers as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; a place that one vector lacks counts as 0."""
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null for a vector of zeros or null."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def relevance(cos: Column) -> Column:
    """Cosine distance (0 to 2) as relevance (1 to 0)."""
    return 1 - (1 - cos) / 2


def resize(a: Column, size: int) -> Column:
    """A vector cut, or filled with zeros, to ``size`` places."""
    return F.slice(F.concat(a.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    powers = F.transform(a, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda s, y: s + y))


def flattened(a: Column) -> Column:
    """A vector that lies in a list of its own, without that list."""
    return F.flatten(a)
