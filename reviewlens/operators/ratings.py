"""Rating distributions, summaries and trends.

All statistics of a rating column start from ``rating_counts``: one map-side-combined aggregation
leaves a row per group and distinct rating. Ratings are stars on a fixed scale, so everything
after it works on a handful of rows per group, whatever the number of reviews or their skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.scalars import axis_break, floor_period, rating_level
from reviewlens.operators.filters import date_bounds

NULL_POLICIES = ("skip", "propagate", "error")


def rating_counts(df: DataFrame, *groups: str) -> DataFrame:
    """Reviews per group and rating, the null rating included."""
    return df.groupBy(*groups, "rating").agg(F.count(F.lit(1)).alias("n"))


def rated(value: Column) -> Column:
    """The value on rows that have a rating, null elsewhere."""
    return F.when(F.col("rating").isNotNull(), value)


def quantiles(shares: list[float]) -> Column:
    """Interpolated quantiles of ``rating`` weighted by ``n``; an aggregate."""
    return F.percentile("rating", F.array(*[F.lit(share) for share in shares]), F.col("n"))


def _group_window(groups: tuple[str, ...]):
    return Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))


def with_moments(counts: DataFrame, *groups: str) -> DataFrame:
    """Adds each group's rated count, mean and sample deviation to its rating counts."""
    group = _group_window(groups)
    n = F.sum(rated(F.col("n"))).over(group)
    total = F.sum(F.col("rating") * F.col("n")).over(group)
    with_mean = counts.withColumns({"n_rated": n, "mean": F.try_divide(total, n)})
    squares = F.sum(F.col("n") * (F.col("rating") - F.col("mean")) ** 2).over(group)
    spread = F.when(F.col("n_rated") > 1, F.sqrt(squares / (F.col("n_rated") - 1)))
    return with_mean.withColumn("sd", spread)


def rating_summary(
    df: DataFrame,
    groups: tuple[str, ...] = ("platform",),
    shares: dict[str, Column] | None = None,
    null_policy: str = "skip",
) -> DataFrame:
    """Count, mean, deviation, quartiles and shares of the ratings of each group.

    ``n`` counts every row. ``null_policy`` says what a null rating does to the statistics of its
    group: nothing, make them null, or fail the query.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    rating = F.col("rating")
    if shares is None:
        shares = {"prop_10": rating == 10, "prop_7_10": rating >= 7, "prop_1_3": rating <= 3}
    counts = with_moments(rating_counts(df, *groups), *groups)
    share_columns = [
        F.try_divide(F.sum(F.when(test, F.col("n")).otherwise(rated(F.lit(0)))), F.max("n_rated"))
        .cast("double")
        .alias(name)
        for name, test in shares.items()
    ]
    summary = counts.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.max("n_rated").alias("n_rated"),
        F.max("mean").alias("mean"),
        F.max("sd").alias("sd"),
        quantiles([0.5, 0.25, 0.75]).alias("q"),
        *share_columns,
    )
    statistics = {
        "mean": F.col("mean"),
        "sd": F.col("sd"),
        "median": F.col("q")[0],
        "p25": F.col("q")[1],
        "p75": F.col("q")[2],
        **{name: F.col(name) for name in shares},
    }
    complete = F.coalesce(F.col("n_rated"), F.lit(0)) == F.col("n")
    if null_policy == "propagate":
        statistics = {k: F.when(complete, v) for k, v in statistics.items()}
    elif null_policy == "error":
        failure = F.raise_error(F.lit("missing ratings are not allowed")).cast("double")
        statistics = {k: F.when(complete, v).otherwise(failure) for k, v in statistics.items()}
    return summary.select(*groups, "n", *[v.alias(k) for k, v in statistics.items()])


def rating_distribution(df: DataFrame, fractional: str = "null") -> DataFrame:
    """Reviews per platform and rating level, and their share of the platform's rated reviews.

    Ratings that are no level form the null level, which stays in the share's denominator.
    """
    levels = df.where(F.col("rating").isNotNull()).select(
        "platform", rating_level(F.col("rating"), fractional).alias("rating")
    )
    return with_share(rating_counts(levels, "platform"), "platform")


def with_share(
    counts: DataFrame, *groups: str, name: str = "prop", of: str = "n", zero: bool = False
) -> DataFrame:
    """Adds each row's share of its group's total; 0 for an empty group when ``zero``."""
    total = F.sum(of).over(_group_window(groups))
    share = F.try_divide(F.col(of), total)
    return counts.withColumn(name, F.coalesce(share, F.lit(0.0)) if zero else share)


def rating_trend(
    df: DataFrame, unit: str = "month", min_n: int = 5, with_sd: bool = False
) -> DataFrame:
    """Mean rating and number of reviews per platform and period, thin periods left out."""
    if unit not in ("month", "week", "day"):
        raise ValueError("unit must be 'month', 'week' or 'day'")
    measures = [F.avg("rating").alias("mean_rating")]
    if with_sd:
        measures.append(F.stddev_samp("rating").alias("sd_rating"))
    return (
        df.groupBy("platform", floor_period(F.col("date"), unit).alias("period"))
        .agg(*measures, F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_n)
    )


def quarter_counts(df: DataFrame) -> DataFrame:
    """Reviews per platform and quarter."""
    quarter = floor_period(F.col("date"), "quarter").alias("period_q")
    return df.groupBy("platform", quarter).agg(F.count(F.lit(1)).alias("n"))


def dense_periods(df: DataFrame, min_n: int = 20, require_all_platforms: bool = False) -> DataFrame:
    """Quarters in which every platform present has at least ``min_n`` reviews.

    With ``require_all_platforms`` a quarter must also have every platform of the table.
    """
    counts = quarter_counts(df)
    quarters = counts.groupBy("period_q").agg(
        F.min("n").alias("least"), F.count(F.lit(1)).alias("platforms")
    )
    dense = quarters.where(F.col("least") >= min_n)
    if require_all_platforms:
        present = counts.agg(F.count_distinct("platform").alias("platforms"))
        dense = dense.where(F.col("platforms") == present.scalar())
    return dense.select("period_q")


def dense_reviews(df: DataFrame, min_n: int = 20, require_all_platforms: bool = False) -> DataFrame:
    """Reviews of the dense quarters. The calendar bounds the quarters, so they are broadcast."""
    quarter = floor_period(F.col("date"), "quarter")
    periods = dense_periods(df, min_n, require_all_platforms).withColumnRenamed("period_q", "q")
    with_quarter = df.withColumn("period_q", quarter)
    same = with_quarter["period_q"].eqNullSafe(periods["q"])
    return with_quarter.join(F.broadcast(periods), same, "left_semi")


def rating_histogram(
    df: DataFrame,
    binwidth: float = 1.0,
    boundary: float = 0.0,
    low: float = 0.5,
    high: float = 10.5,
) -> DataFrame:
    """Reviews per platform and bin; bins are closed on the right, ratings off the axis dropped."""
    position = (F.col("rating") - F.lit(boundary)) / F.lit(binwidth)
    first = F.floor((F.lit(low) - F.lit(boundary)) / F.lit(binwidth)) + 1
    bins = df.where(F.col("rating").between(low, high)).select(
        "platform", F.greatest(F.ceil(position), first).alias("bin")
    )
    counts = bins.groupBy("platform", "bin").agg(F.count(F.lit(1)).alias("n"))
    upper = F.lit(float(boundary)) + F.col("bin") * F.lit(float(binwidth))
    return counts.select(
        "platform", (upper - F.lit(float(binwidth))).alias("bin_low"), upper.alias("bin_high"), "n"
    )


def rating_boxstats(df: DataFrame, low: float = 1.0, high: float = 10.0) -> DataFrame:
    """Hinges, whiskers and outlier count of each platform's ratings on the axis.

    A whisker ends at the last rating within 1.5 box heights of the box, and never inside the box.
    """
    counts = rating_counts(df.where(F.col("rating").between(low, high)), "platform")
    hinges = quantiles([0.25, 0.5, 0.75]).over(Window.partitionBy("platform"))
    fence = (F.col("q")[2] - F.col("q")[0]) * 1.5
    inside = F.col("rating").between(F.col("q")[0] - fence, F.col("q")[2] + fence)
    return (
        counts.withColumn("q", hinges)
        .withColumn("inside", inside)
        .groupBy("platform")
        .agg(
            F.sum("n").alias("n"),
            F.least(F.min(F.when(F.col("inside"), F.col("rating"))), F.max(F.col("q")[0])).alias(
                "whisker_low"
            ),
            F.max(F.col("q")[0]).alias("hinge_low"),
            F.max(F.col("q")[1]).alias("median"),
            F.max(F.col("q")[2]).alias("hinge_high"),
            F.greatest(F.max(F.when(F.col("inside"), F.col("rating"))), F.max(F.col("q")[2])).alias(
                "whisker_high"
            ),
            F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("n_outliers"),
        )
    )


def rating_density(
    df: DataFrame,
    groups: tuple[str, ...] = ("platform",),
    low: float = 1.0,
    high: float = 10.0,
    points: int = 512,
    extend: bool = False,
) -> DataFrame:
    """Gaussian kernel density of the ratings of each group on an even grid.

    The grid spans the axis, or with ``extend`` each group's data and three bandwidths beyond.
    The bandwidth is the normal reference rule, 0.9 min(sd, IQR/1.34) n^-0.2; groups of one
    review have none and are left out. Every distinct rating adds its kernel to every grid point,
    so the work is groups x distinct ratings x points, independent of the number of reviews.
    """
    group = _group_window(groups)
    kept = df.where(F.col("rating").between(low, high))
    quartiles = quantiles([0.25, 0.75]).over(group)
    counts = (
        with_moments(rating_counts(kept, *groups), *groups)
        .withColumns(
            {
                "q": quartiles,
                "first": F.min("rating").over(group),
                "last": F.max("rating").over(group),
            }
        )
        .where(F.col("n_rated") > 1)
    )
    robust = F.least(F.col("sd"), (F.col("q")[1] - F.col("q")[0]) / F.lit(1.34))
    spread = (
        F.when(robust > 0, robust)
        .when(F.col("sd") > 0, F.col("sd"))
        .when(F.col("first") != 0, F.abs("first"))
        .otherwise(F.lit(1.0))
    )
    bandwidth = F.lit(0.9) * spread * F.col("n_rated") ** F.lit(-0.2)
    with_grid = counts.withColumn("bandwidth", bandwidth).withColumns(
        {
            "start": F.col("first") - 3 * F.col("bandwidth") if extend else F.lit(float(low)),
            "stop": F.col("last") + 3 * F.col("bandwidth") if extend else F.lit(float(high)),
            "point": F.explode(F.sequence(F.lit(0), F.lit(points - 1))),
        }
    )
    step = (F.col("stop") - F.col("start")) / F.lit(points - 1)
    x = F.col("start") + F.col("point") * step
    distance = (F.col("x") - F.col("rating")) / F.col("bandwidth")
    kernel = F.col("n") * F.exp(-distance * distance / 2)
    scale = F.col("n_rated") * F.col("bandwidth") * F.sqrt(2 * F.pi())
    return (
        with_grid.withColumn("x", x)
        .groupBy(*groups, "point")
        .agg(
            F.max("x").alias("x"),
            F.max("bandwidth").alias("bandwidth"),
            F.sum(kernel / scale).alias("density"),
        )
    )


def trend_axis(trend: DataFrame) -> DataFrame:
    """One row: the span of a trend's periods and the axis spacing that suits it."""
    bounds = date_bounds(trend, "period")
    return bounds.withColumn("axis_break", axis_break(F.col("span_days")))
