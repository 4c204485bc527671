"""Columns for vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_vector(vector: Column, dimension: int) -> Column:
    """Of that length, all values finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def digest_vector(text: Column, dimension: int) -> Column:
    """A stand-in for a model: the bytes of the text's digest, scaled to -1 to 1, over and over."""
    digest = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: byte(i) / F.lit(255.0) * F.lit(2.0) - F.lit(1.0))
