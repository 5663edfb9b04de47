"""Vectors and model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is null or all zeros."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def softmax_positive(z0: Column, z1: Column) -> Column:
    """P(class 1) of two logits."""
    return 1 / (1 + F.exp(z0 - z1))


def argmax(values: Column) -> Column:
    """0-based place of the first greatest element; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1)


def mean_pool(hidden: Column, mask: Column) -> Column:
    """Masked mean of token vectors: sum(mask * h) / max(sum(mask), 1e-9)."""
    total = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double"))
    width = F.size(F.element_at(hidden, 1))
    zero = F.transform(F.sequence(F.lit(1), width), lambda _: F.lit(0.0))
    summed = F.aggregate(F.zip_with(hidden, mask, lambda h, m: F.transform(h, lambda x: x.cast("double") * m)), zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    return F.transform(summed, lambda x: x / F.greatest(total, F.lit(1e-9)))
