"""Vector expressions over array columns; results are doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    squares = F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.sqrt(squares)


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL for a zero vector, and for vectors of different length."""
    lengths = F.nullif(norm(a) * norm(b), F.lit(0.0))
    return F.when(F.size(a) == F.size(b), dot(a, b) / lengths)


def l2_normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda v: (v / size).cast("float")))
