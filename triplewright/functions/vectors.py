"""Vectors as array<double> columns; folds run in element order, so sums don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def double(v: Column) -> Column:
    return v.cast("array<double>")


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column, p: int = 1) -> Column:
    return total(F.transform(a, F.abs)) if p == 1 else F.sqrt(total(F.transform(a, lambda x: x * x)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: lambdas compute what they mention at each element, but not their own variable."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column, p: int = 2) -> Column:
    return bound(F.greatest(norm(a, p), F.lit(1e-12)), lambda length: F.transform(a, lambda x: x / length))


def middle(a: Column, b: Column) -> Column:
    """Mean of two vectors: of two hidden layers, or of the ends of a span."""
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a, 2) * norm(b, 2), F.lit(1e-12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    raised = bound(a, lambda v: bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
    return bound(raised, lambda r: bound(total(r), lambda s: F.transform(r, lambda x: x / s)))


def linear(x: Column, weight: list[list[float]], bias: list[float]) -> Column:
    """W x + b for a constant weight, one dot product for each output."""
    return F.array(*[dot(x, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b)) for row, b in zip(weight, bias, strict=True)])


def tanh(a: Column) -> Column:
    return F.transform(a, F.tanh)


def mean_of(vectors: Column, dims: int) -> Column:
    """Mean of an array of vectors, by position."""
    zero = F.array_repeat(F.lit(0.0), dims)
    n = F.greatest(F.size(vectors), F.lit(1))
    return F.aggregate(vectors, zero, plus, lambda s: F.transform(s, lambda x: x / n))


def padded(a: Column, size: int) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(0.0), size)), 1, size)
