"""Token hashing and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 128


def token_bucket(token: Column, dimensions: int = DIMENSIONS) -> Column:
    """Dimension of a token: the first eight hex digits of its MD5 as a number, modulo the dimensions."""
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Cosine of two vectors: 0 if one has no length, null if their dimensions differ."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    dot = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    lengths = norm(left) * norm(right)
    return F.when(F.size(left) == F.size(right), F.when(lengths > 0, dot / lengths).otherwise(F.lit(0.0)))
