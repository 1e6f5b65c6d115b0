"""Vector measures as column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean", "manhattan")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / length)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 with a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x)


def negate(value: Column) -> Column:
    return -value


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: cosine, dot, and negated euclidean and manhattan."""
    if metric in ("cosine", "dot"):
        return {"cosine": cosine, "dot": dot}[metric](a, b)
    if metric in ("euclidean", "manhattan"):
        return negate({"euclidean": euclidean, "manhattan": manhattan}[metric](a, b))
    raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def distance(metric: str, a: Column, b: Column) -> Column:
    """Lower is nearer: 1 - cosine, 1 - dot, euclidean, manhattan."""
    value = similarity(metric, a, b)
    return 1 - value if metric in ("cosine", "dot") else -value
