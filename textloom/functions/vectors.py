"""Column builders for vectors in array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import c


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column | str, epsilon: float = 0.0) -> Column:
    """The vector over its norm plus epsilon; null for a zero vector without epsilon."""
    length = norm(a) + F.lit(epsilon)
    return F.when(length > 0, F.transform(c(a), lambda x: x.cast("double") / length))


def cosine(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def minus(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(c(a), c(b), lambda x, y: x.cast("double") - y.cast("double"))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(minus(a, b), F.lit(0.0), lambda s, x: s + x * x)


def mean_vector(a: Column | str, dim: int) -> Column:
    """Aggregate: the element-wise mean, one partial average per element, combined before the shuffle."""
    return F.array(*[F.avg(F.get(c(a), F.lit(i)).cast("double")) for i in range(dim)])


def sum_vector(a: Column | str, dim: int) -> Column:
    return F.array(*[F.sum(F.get(c(a), F.lit(i)).cast("double")) for i in range(dim)])
