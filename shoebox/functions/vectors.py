"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """Divided by its length; a zero vector stays zero."""
    size = norm(v)
    return F.when(size > 0, F.transform(doubles(v), lambda x: x / size)).otherwise(doubles(v))


def automatic_k(n: int) -> int:
    """Number of clusters for n points: half the points, rooted, at least 2, within 1..n."""
    return max(1, min(max(2, math.isqrt(n // 2)), n))
