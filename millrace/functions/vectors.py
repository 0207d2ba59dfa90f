"""Distances of vectors and the scores made of them. Arrays of numbers; arithmetic in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    """A query vector as a constant."""
    return F.array(*(F.lit(float(x)) for x in v))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def inner(a: Column, b: Column) -> Column:
    """Inner product."""
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance; null if a norm is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, 1 - inner(a, b) / size)


def negative_inner(a: Column, b: Column) -> Column:
    return -inner(a, b)


METRICS = {"l2": l2, "cosine": cosine, "ip": negative_inner}


def normalized(v: Column) -> Column:
    """The vector over its norm; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def same_width(v: Column, width: int) -> Column:
    """The vector, or an error if its length is another."""
    return F.when(F.size(v) == width, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {width} dimensions, got "), F.size(v).cast("string"))))


def clamped(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def keyword_score(bm25: Column) -> Column:
    """1 / (1 + |bm25|): a better hit scores lower."""
    return clamped(1 / (1 + F.abs(bm25)))


def l2_score(d: Column) -> Column:
    return 1 / (1 + d)


def cosine_score(d: Column) -> Column:
    """Also the score of Euclidean distances in Postgres stores, 0 from distance 1 on."""
    return F.greatest(F.lit(0.0), 1 - d)


def ip_score(d: Column) -> Column:
    """Of negative inner products: the best hits score lowest."""
    return clamped((d + 1) / 2)
