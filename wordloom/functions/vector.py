"""Vector arithmetic as column expressions over arrays of numbers, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Scalar product; null if either side is null or holds one."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def l2_norm(v: Column) -> Column:
    """Euclidean length; 0 for a zero or empty vector."""
    return F.sqrt(dot(v, v))


def scale(v: Column, factor: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * factor)


def l2_normalize(v: Column, norm: Column | None = None) -> Column:
    """The vector of length 1; a zero vector stays as it is."""
    norm = l2_norm(v) if norm is None else norm
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)
    )


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def analogy_offset(a: Column, b: Column, c: Column) -> Column:
    """b - a + c: where the fourth term of "a is to b as c is to" should be."""
    return add(subtract(b, a), c)


def cosine_similarity(score: Column) -> Column:
    """The score itself, for vectors of length 1."""
    return score


def angular_similarity(score: Column) -> Column:
    """1 - angle / pi; NaN for a score outside [-1, 1]."""
    return 1 - F.acos(score) / F.lit(math.pi)


def euclidean_distance(score: Column) -> Column:
    """Distance of two unit vectors of that cosine; NaN for a score above 1."""
    return F.sqrt(2 - 2 * score)


def euclidean_similarity(score: Column) -> Column:
    return 1 - euclidean_distance(score) / 2


def pooled_sum(vector: Column, dims: int, weight: Column | None = None) -> list[Column]:
    """Aggregates, one a component: partial sums are made before the shuffle."""
    factor = F.lit(1.0) if weight is None else weight.cast("double")
    return [F.sum(F.get(vector, F.lit(i)).cast("double") * factor).alias(f"_{i}") for i in range(dims)]


def pooled_array(dims: int) -> Column:
    """The vector of the columns that pooled_sum() gives."""
    return F.array(*[F.col(f"_{i}") for i in range(dims)]) if dims else F.array().cast("array<double>")


def to_float(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("float"))
