"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; one that is shorter than 1e-9 stays as it is."""
    return F.transform(a.cast("array<double>"), lambda x: x / F.when(norm(a) > 1e-9, norm(a)).otherwise(1.0))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(F.when(size.isNotNull(), F.lit(0.0)))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "l2sq":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)
    raise ValueError(metric)


def relevance_pct(score: Column) -> Column:
    """Per cent of relevance of a distance, rounded half-even; null below 0."""
    return F.when(score >= 0, F.greatest(F.lit(0), F.bround((1 - score) * 100, 0))).cast("bigint")
