"""Early against late reviews."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.scalars import floor_period, rating_level
from reviewlens.operators.ratings import rating_counts, rating_summary, with_share


def phase(is_early: Column) -> Column:
    """``early`` or ``late``; null when the test is."""
    return F.when(is_early, "early").when(~is_early, "late")


def quantile_date(df: DataFrame, share: float) -> DataFrame:
    """One row, ``cutoff_date``: the first date by which ``share`` of the dated rows are in.

    Rows are counted per day first. The calendar bounds the days, so the running count over all
    of them is a small window in one task.
    """
    days = df.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("date"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    # The tolerance, four machine epsilons, absorbs the rounding of the product.
    rank = F.greatest(F.ceil(F.col("total") * F.lit(float(share)) - F.lit(4 * 2.0**-52)), F.lit(1))
    return (
        days.withColumns({"running": running, "total": total})
        .where(F.col("running") >= rank)
        .agg(F.min("date").alias("cutoff_date"))
    )


def early_late_split(df: DataFrame, share: float = 0.5) -> DataFrame:
    """Labels rows up to the ``share``-quantile date of all rows ``early``, later ones ``late``."""
    cutoff = quantile_date(df, share)
    with_cutoff = df.withColumn("cutoff_date", cutoff.scalar())
    return with_cutoff.withColumn("period_group", phase(F.col("date") <= F.col("cutoff_date")))


def early_late_cutoff(df: DataFrame, cutoff: date | str) -> DataFrame:
    """Labels rows before the cutoff ``early``, from it on ``late``."""
    with_cutoff = df.withColumn("cutoff_date", F.lit(cutoff).cast("date"))
    return with_cutoff.withColumn("period_group", phase(F.col("date") < F.col("cutoff_date")))


def early_late_summary(df: DataFrame, share: float = 0.5, null_policy: str = "skip") -> DataFrame:
    """Rating summary per platform and early/late group."""
    rating = F.col("rating")
    return rating_summary(
        early_late_split(df, share),
        groups=("platform", "period_group"),
        shares={"prop_10": rating == 10, "prop_9_10": rating >= 9},
        null_policy=null_policy,
    )


def early_late_normalised(
    df: DataFrame, cut: date | str, platforms: list[str] | None = None
) -> DataFrame:
    """Rating shares within each phase, then each phase's part of the shares of one rating.

    A review's phase follows from the first day of its quarter.
    """
    is_early = floor_period(F.col("date"), "quarter") < F.lit(cut).cast("date")
    levels = df.where(F.col("rating").isNotNull()).select(
        "platform",
        phase(is_early).alias("phase"),
        rating_level(F.col("rating"), "truncate").alias("rating"),
    )
    if platforms is not None:
        levels = levels.where(F.col("platform").isin(platforms))
    within_phase = with_share(
        rating_counts(levels, "platform", "phase"), "platform", "phase", name="prop_phase"
    )
    return with_share(within_phase, "platform", "rating", name="prop_norm", of="prop_phase")
