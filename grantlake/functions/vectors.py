"""Column functions over embedding arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for an empty, zero-length or differently sized vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    unusable = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(unusable, 0.0).otherwise(F.when(norms == 0.0, 0.0).otherwise(dot(a, b) / norms))
