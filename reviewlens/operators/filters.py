"""Row selection."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_reviews(
    df: DataFrame,
    start: date | str | None = None,
    end: date | str | None = None,
    platform: str = "both",
    platforms: Iterable[str] | None = None,
    choices: Iterable[str] | None = None,
) -> DataFrame:
    """Rows within the closed date range and of the platform; a null bound is open.

    ``platform="both"`` keeps all platforms, ``platforms`` keeps several. With ``choices`` an
    unknown platform is an error.
    """
    if choices is not None and platform not in {"both", *choices}:
        raise ValueError(f"platform must be 'both' or one of {sorted(choices)}, not {platform!r}")
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if platform != "both":
        df = df.where(F.col("platform") == platform)
    if platforms is not None:
        df = df.where(F.col("platform").isin(list(platforms)))
    return df


def filter_rating(
    df: DataFrame, low: float | None = None, high: float | None = None, rating: str = "rating"
) -> DataFrame:
    """Rows within the closed rating range; a null rating goes as soon as a bound is set."""
    if low is not None:
        df = df.where(F.col(rating) >= low)
    if high is not None:
        df = df.where(F.col(rating) <= high)
    return df


def in_region(
    x_low: float, x_high: float, y_low: float, y_high: float, x: str = "dim1", y: str = "dim2"
) -> Column:
    """Whether a point lies in the closed rectangle."""
    return F.col(x).between(x_low, x_high) & F.col(y).between(y_low, y_high)


def select_region(
    df: DataFrame, x_low: float, x_high: float, y_low: float, y_high: float, **axes: str
) -> DataFrame:
    return df.where(in_region(x_low, x_high, y_low, y_high, **axes))


def date_bounds(df: DataFrame, date_column: str = "date") -> DataFrame:
    """One row: first and last date and the days between them."""
    bounds = df.agg(F.min(date_column).alias("date_min"), F.max(date_column).alias("date_max"))
    return bounds.withColumn("span_days", F.date_diff("date_max", "date_min"))
