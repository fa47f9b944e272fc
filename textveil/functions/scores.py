"""Column -> Column score arithmetic on numbers and arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from textveil.constants import BAND_LOW, BAND_MEDIUM
from textveil.functions.text import as_col


def sigmoid(x) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(x)))


def softmax(logits) -> Column:
    """Softmax of an array, shifted by its maximum."""
    a = as_col(logits)
    top = F.array_max(a)
    total = F.aggregate(F.transform(a, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, F.transform(a, lambda x: F.exp(x - top) / total)).otherwise(
        F.array().cast("array<double>")
    )


def argmax(values) -> Column:
    """Zero-based position of the first maximum."""
    a = as_col(values)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(index, n: int) -> Column:
    i = as_col(index)
    return F.array(*[F.when(i == k, 1.0).otherwise(0.0) for k in range(n)])


def score_band(score) -> Column:
    s = as_col(score)
    return F.when(s < BAND_LOW, "low").when(s < BAND_MEDIUM, "medium").otherwise("high")


def cosine(a, b) -> Column:
    """Cosine of two equally long numeric arrays; null if one is all zero."""
    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda s, v: s + v,
        )

    a, b = as_col(a), as_col(b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def safe_ratio(num, den) -> Column:
    """``num / den`` or 0 where undefined."""
    return F.coalesce(F.try_divide(as_col(num).cast("double"), as_col(den)), F.lit(0.0))
