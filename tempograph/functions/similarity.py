"""Similarity of sets, numbers, structures and vectors, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def overlap(a: Column, b: Column) -> Column:
    """Shared elements over the larger set's size; 0 if either is empty."""
    size = F.greatest(F.size(a), F.size(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / size).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """1 if both sets are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(1.0))


def jaccard_of(shared: Column, a: Column, b: Column) -> Column:
    """The same of the number of shared elements and the sizes of two sets, whose elements are distinct."""
    union = a + b - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(1.0))


def numeric_similarity(a: Column, b: Column) -> Column:
    """1 - |a - b| / max(1, a, b) within 0..1; 0 where either is null."""
    x, y = a.cast("double"), b.cast("double")
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(x - y) / F.greatest(F.lit(1.0), x, y)))
    return F.when(x.isNotNull() & y.isNotNull(), s).otherwise(F.lit(0.0))


def structural_overlap(features: Column, nodes: Column, depth: Column, arity: Column) -> Column:
    return features * 0.65 + nodes * 0.15 + depth * 0.10 + arity * 0.10


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or either vector is zero."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / F.when(n > 0, n)).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))


def saturating(x: Column) -> Column:
    """1 - exp(-x / 3)."""
    return 1 - F.exp(-x / 3)


def rank_strength(exact: Column, rank: Column) -> Column:
    return F.when(exact, F.lit(1.2)).otherwise(F.lit(1.0)) / F.log2(rank + 1)
