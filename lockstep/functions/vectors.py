"""Arrays of doubles as vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import ratio


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def with_bias(features: Column) -> Column:
    """A constant 1.0 in front."""
    return F.concat(F.array(F.lit(1.0)), features)


def filled(v: Column) -> Column:
    """Null elements as 0.0."""
    return F.transform(v, lambda x: F.coalesce(x, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_with(columns: Sequence[Column], weights: Sequence[float]) -> Column:
    """Columns times fixed weights, unrolled, which stays in generated code."""
    return sum((c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)), F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null elements are 0, and a zero vector gives NaN."""
    return ratio(dot(filled(a), filled(b)), norm(filled(a)) * norm(filled(b)))
