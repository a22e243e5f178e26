"""Vector and score functions (MTH1-4): built-in expressions, kept in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if a vector is empty or zero."""
    n = F.least(F.size(a), F.size(b))
    left, right = F.slice(a, 1, n), F.slice(b, 1, n)
    size = norm(left) * norm(right)
    return F.when((n > 0) & (size > 0), dot(left, right) / size).otherwise(0.0)


def unit(v: Column) -> Column:
    """Non-finite components become 0; scaled to length one unless it is below 1e-10."""
    clean = F.transform(doubles(v), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x))
    size = norm(clean)
    return F.when(size < 1e-10, clean).otherwise(F.transform(clean, lambda x: x / size))


def rank_score(rank: Column) -> Column:
    """A keyword rank, negative for better matches, as a score in (0, 1)."""
    finite = rank.isNotNull() & ~F.isnan(rank) & (F.abs(rank) != float("inf"))
    return F.when(~finite, 1 / 1000).when(rank < 0, -rank / (1 - rank)).otherwise(1 / (1 + rank))


def fused(vector: Column, keyword: Column, vector_weight: float, keyword_weight: float) -> Column:
    return vector_weight * vector + keyword_weight * keyword
