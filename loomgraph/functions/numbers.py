"""Arithmetic on columns, arrays and spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, least: float = 0.0, most: float = 1.0) -> Column:
    """NaN counts as the least value."""
    return F.when(F.isnan(c), F.lit(least)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), c)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for different lengths or a zero vector; not clamped."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (n == 0), F.lit(0.0)).otherwise(dot(a, b) / n)


def similarity(a: Column, b: Column) -> Column:
    """Cosine within 0 and 1, 0 for a zero vector; different lengths raise an error."""
    return F.when(F.assert_true(F.size(a) == F.size(b), F.lit("vectors of different lengths")).isNull(), clamp(cosine(a, b)))


def span_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of half-open spans; 0 when one is missing or empty."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(a0.isNull() | a1.isNull() | b0.isNull() | b1.isNull() | (union <= 0), F.lit(0.0)).otherwise(inter / union)


def mean_vectors(a: Column, b: Column) -> Column:
    """Element by element; the first where lengths differ."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: (x + y) / 2)).otherwise(a)


def path_confidence(values: Column) -> Column:
    """Product of what is known, within 0 and 1; null if nothing is."""
    known = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, clamp(F.aggregate(known, F.lit(1.0), lambda s, x: s * x)))


def merge_documents(a: Column, b: Column) -> Column:
    return F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def sorted_aliases(a: Column, b: Column) -> Column:
    """Union of aliases, in the order of their lower case."""
    return F.array_sort(merge_documents(a, b), lambda x, y: F.when(F.lower(x) < F.lower(y), -1).when(F.lower(x) > F.lower(y), 1).when(x < y, -1).when(x > y, 1).otherwise(0))


def prf(tp: Column, predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Precision, recall, F1; all 1 when both are empty."""
    p = F.when((predicted == 0) & (gold == 0), 1.0).when(predicted == 0, 0.0).otherwise(tp / predicted)
    r = F.when((predicted == 0) & (gold == 0), 1.0).when(gold == 0, 0.0).otherwise(tp / gold)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))
