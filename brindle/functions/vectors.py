"""Vectors as arrays: products, norms, truncation, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision."""
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """To unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(_double(v), lambda x: x / n)).otherwise(_double(v))


def truncated(v: Column, size: int) -> Column:
    """The first ``size`` places, to unit length again."""
    return normalized(F.slice(v, 1, size))


def softmax(logits: Column) -> Column:
    """Probabilities of logits."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(exps, F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def score_cap(positive: Column, relative: float | None = None, margin: float | None = None) -> Column:
    """Highest score a negative may have: relative before absolute margin, null for none."""
    if relative is not None:
        return positive * (1 - relative)
    if margin is not None:
        return positive - margin
    return F.lit(None).cast("double")
