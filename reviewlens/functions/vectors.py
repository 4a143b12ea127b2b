"""Arithmetic on ``ARRAY<FLOAT|DOUBLE>`` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body).getItem(0)


def dot(left: Column, right: Column) -> Column:
    """Sum of products, in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(vector: Column) -> Column:
    """Euclidean length."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def unit(vector: Column) -> Column:
    """The vector at length one; null for a zero vector, which has no direction."""
    return let(
        norm(vector),
        lambda length: F.when(
            length > 0, F.transform(vector, lambda x: x.cast("double") / length)
        ),
    )
