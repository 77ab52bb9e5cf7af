"""Column functions on vectors, sets and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """In double, not clamped; independent of magnitude."""
    return dot(a, b) / (norm(a) * norm(b))


def l2_normalise(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / norm(a))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is empty or null."""
    size = F.size(F.array_union(a, b))
    return F.when(F.coalesce(F.size(a) <= 0, F.lit(True)) | F.coalesce(F.size(b) <= 0, F.lit(True)), 0.0).otherwise(F.size(F.array_intersect(a, b)) / size)


def minmax(value: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.0).otherwise((value - low) / (high - low))


def weighted(vector: Column, file: Column, bm25: Column, weights: tuple[float, float, float]) -> Column:
    return vector * weights[0] + file * weights[1] + bm25 * weights[2]


def top_mean(scores: Column, k: int) -> Column:
    """The mean of the k best, by how many there are; scores: array."""
    best = F.slice(F.sort_array(scores, False), 1, k)
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)


def band(gap: Column) -> Column:
    return F.when(gap > 0.15, "strong").when(gap >= 0.05, "weak").otherwise("none")


def literal_of(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))
