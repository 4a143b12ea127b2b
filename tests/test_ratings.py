import math
from datetime import date

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewlens.functions import scalars
from reviewlens.operators import filters, ratings, timesplit

SCHEMA = "id string, platform string, date date, rating double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, fractional and out-of-range ratings on two platforms."""
    values = [10.0, 7.5, 0.0, 11.0, None, 1.0]
    return frame(
        spark,
        [
            (f"{p}{i}", p, date(2020, 1, 1 + i), v)
            for p in ("alpha", "beta")
            for i, v in enumerate(values)
        ],
    ).cache()


def by(df, *keys):
    return {tuple(row[k] for k in keys): row for row in df.collect()}


def test_distribution_keeps_the_null_level_in_the_denominator(odd):
    rows = by(ratings.rating_distribution(odd), "platform", "rating")
    assert {k[1] for k in rows} == {1, 10, None}
    assert rows["alpha", None].n == 3 and rows["alpha", None].prop == pytest.approx(0.6)
    truncated = by(ratings.rating_distribution(odd, "truncate"), "platform", "rating")
    assert {k[1] for k in truncated} == {1, 7, 10, None}
    assert truncated["beta", 7].prop == pytest.approx(0.2)
    with pytest.raises(ValueError):
        ratings.rating_distribution(odd, "round")


def test_summary_null_policies(odd):
    row = by(ratings.rating_summary(odd), "platform")["alpha",]
    values = np.array([10.0, 7.5, 0.0, 11.0, 1.0])
    assert row.n == 6
    assert row["mean"] == pytest.approx(values.mean())
    assert row.sd == pytest.approx(values.std(ddof=1))
    assert [row.p25, row["median"], row.p75] == pytest.approx(
        list(np.percentile(values, [25, 50, 75]))
    )
    assert (row.prop_10, row.prop_7_10, row.prop_1_3) == pytest.approx((0.2, 0.6, 0.4))
    null = by(ratings.rating_summary(odd, null_policy="propagate"), "platform")["alpha",]
    assert null.n == 6 and null["mean"] is None and null.p25 is None and null.prop_10 is None
    with pytest.raises(PySparkException, match="missing ratings"):
        ratings.rating_summary(odd, null_policy="error").collect()
    with pytest.raises(ValueError):
        ratings.rating_summary(odd, null_policy="ignore")


def test_summary_of_one_and_of_no_rating(spark):
    df = frame(spark, [("1", "alpha", None, 4.0), ("2", "beta", None, None)])
    rows = by(ratings.rating_summary(df), "platform")
    assert rows["alpha",].sd is None and rows["alpha",].p75 == 4.0
    assert rows["beta",].n == 1 and rows["beta",]["mean"] is None and rows["beta",].prop_10 is None


def test_filters(odd):
    assert filters.filter_reviews(odd).count() == 12
    kept = filters.filter_reviews(odd, "2020-01-02", date(2020, 1, 3), "beta")
    assert sorted(row.id for row in kept.collect()) == ["beta1", "beta2"]
    assert filters.filter_reviews(odd, platforms=["alpha", "gamma"]).count() == 6
    with pytest.raises(ValueError):
        filters.filter_reviews(odd, platform="gamma", choices=["alpha", "beta"])
    assert filters.filter_rating(odd).count() == 12
    assert filters.filter_rating(odd, low=1).count() == 8
    assert filters.filter_rating(odd, 1, 10).count() == 6


def test_null_date_is_dropped_by_a_range_and_has_no_phase(spark):
    df = frame(spark, [("1", "a", None, 1.0), ("2", "a", date(2020, 5, 1), 2.0)])
    assert filters.filter_reviews(df, start="2000-01-01").count() == 1
    labels = by(timesplit.early_late_cutoff(df, "2020-05-01"), "id")
    assert labels["1",].period_group is None and labels["2",].period_group == "late"
    split = by(timesplit.early_late_split(df), "id")
    assert split["1",].period_group is None and split["2",].period_group == "early"


def test_quantile_date_is_one_of_the_dates(spark):
    days = [date(2020, 1, d) for d in (1, 5, 9, 20)]
    df = frame(spark, [(str(i), "a", d, 1.0) for i, d in enumerate(days)])
    for share, expected in ((0.0, 0), (0.25, 0), (0.3, 1), (0.5, 1), (0.51, 2), (1.0, 3)):
        assert timesplit.quantile_date(df, share).first().cutoff_date == days[expected]
    empty = timesplit.early_late_split(df.limit(0))
    assert empty.count() == 0


def test_periods(spark):
    df = frame(spark, [("1", "a", date(2024, 1, 7), 2.0), ("2", "a", date(2024, 2, 29), 4.0)])
    def period(unit):
        trend = ratings.rating_trend(df, unit, min_n=1)
        return sorted(row.period.isoformat() for row in trend.collect())

    assert period("week") == ["2024-01-01", "2024-02-26"]
    assert period("month") == ["2024-01-01", "2024-02-01"]
    assert period("day") == ["2024-01-07", "2024-02-29"]
    assert ratings.rating_trend(df, "month").count() == 0
    with pytest.raises(ValueError):
        ratings.rating_trend(df, "year")
    quarters = ratings.quarter_counts(df).collect()
    assert [(row.period_q.isoformat(), row.n) for row in quarters] == [("2024-01-01", 2)]


@pytest.mark.parametrize(
    ("days", "spacing"),
    [(0, "1 month"), (182, "1 month"), (183, "3 months"), (548, "6 months"), (1095, "1 year")],
)
def test_axis_break(spark, days, spacing):
    row = spark.range(1).select(scalars.axis_break(F.lit(days)).alias("s")).first()
    assert row.s == spacing


def test_dense_quarters(spark):
    rows = [(f"a{i}", "alpha", date(2020, 1, 1), 1.0) for i in range(20)]
    rows += [(f"b{i}", p, date(2020, 4, 1), 1.0) for p in ("alpha", "beta") for i in range(20)]
    rows += [(f"c{i}", "alpha", date(2020, 7, 1), 1.0) for i in range(20)]
    rows += [(f"d{i}", "beta", date(2020, 7, 1), 1.0) for i in range(19)]
    rows += [(f"e{i}", "beta", None, 1.0) for i in range(25)]
    df = frame(spark, rows)
    found = {row.period_q for row in ratings.dense_periods(df).collect()}
    assert found == {date(2020, 1, 1), date(2020, 4, 1), None}
    strict = {row.period_q for row in ratings.dense_periods(df, 20, True).collect()}
    assert strict == {date(2020, 4, 1)}
    assert ratings.dense_reviews(df).count() == 20 + 40 + 25


def test_histogram_bins_are_closed_on_the_right(spark):
    values = [0.5, 1.0, 1.5, 2.0, 10.0, 10.5, 10.6, 0.4, None]
    df = frame(spark, [(str(i), "a", None, v) for i, v in enumerate(values)])
    rows = {(r.bin_low, r.bin_high): r.n for r in ratings.rating_histogram(df).collect()}
    assert rows == {(0.0, 1.0): 2, (1.0, 2.0): 2, (9.0, 10.0): 1, (10.0, 11.0): 1}


def test_boxstats(spark):
    values = [1.0, 6.0, 6.0, 7.0, 7.0, 7.0, 8.0, 8.0, 10.0, 0.0, 12.0, None]
    df = frame(spark, [(str(i), "a", None, v) for i, v in enumerate(values)])
    row = ratings.rating_boxstats(df).first()
    assert (row.n, row.hinge_low, row["median"], row.hinge_high) == (9, 6.0, 7.0, 8.0)
    assert (row.whisker_low, row.whisker_high, row.n_outliers) == (6.0, 10.0, 1)


def test_density_integrates_to_one_and_skips_lone_reviews(spark):
    values = [2.0, 3.0, 3.0, 4.0, 4.0, 4.0, 5.0, 6.0]
    rows = [(str(i), "a", None, v) for i, v in enumerate(values)]
    rows += [("x", "lone", None, 5.0), ("y", "same", None, 5.0), ("z", "same", None, 5.0)]
    grid = ratings.rating_density(frame(spark, rows), extend=True)
    assert {row.platform for row in grid.select("platform").distinct().collect()} == {"a", "same"}
    points = grid.where("platform = 'a'").orderBy("point").toPandas()
    q1, q3 = np.percentile(values, [25, 75])
    width = 0.9 * min(np.std(values, ddof=1), (q3 - q1) / 1.34) * len(values) ** -0.2
    assert points.bandwidth[0] == pytest.approx(width)
    assert len(points) == 512 and points.x[0] == pytest.approx(2 - 3 * width)
    assert np.trapezoid(points.density, points.x) == pytest.approx(1, abs=0.01)
    by_hand = np.exp(-0.5 * ((points.x[100] - np.array(values)) / width) ** 2).mean()
    assert points.density[100] == pytest.approx(by_hand / (width * math.sqrt(2 * math.pi)))
    same = grid.where("platform = 'same'").first()
    assert same.bandwidth == pytest.approx(0.9 * 5 * 2**-0.2)


def test_early_late_normalised(spark):
    rows = [(f"e{i}", "a", date(2020, 3, 31), 10.0 if i < 1 else 1.0) for i in range(10)]
    rows += [(f"l{i}", "a", date(2020, 4, 1), 10.9 if i < 2 else 1.0) for i in range(10)]
    normalised = timesplit.early_late_normalised(frame(spark, rows), "2020-04-01")
    result = by(normalised, "phase", "rating")
    assert result["early", 10].prop_phase == pytest.approx(0.1)
    assert result["early", 10].prop_norm == pytest.approx(1 / 3)
    assert result["late", 10].prop_norm == pytest.approx(2 / 3)
    none = timesplit.early_late_normalised(frame(spark, rows), "2020-04-01", ["b"])
    assert none.count() == 0


def test_early_late_summary_splits_over_both_platforms_together(spark):
    rows = [(f"a{i}", "a", date(2020, 1, 1 + i), 10.0) for i in range(6)]
    rows += [(f"b{i}", "b", date(2020, 1, 20), 9.0) for i in range(2)]
    result = by(timesplit.early_late_summary(frame(spark, rows)), "platform", "period_group")
    assert {k: row.n for k, row in result.items()} == {
        ("a", "early"): 4, ("a", "late"): 2, ("b", "late"): 2,
    }
    assert result["b", "late"].prop_10 == 0 and result["b", "late"].prop_9_10 == 1


def test_date_bounds(odd):
    row = filters.date_bounds(odd).first()
    assert (row.date_min, row.date_max, row.span_days) == (date(2020, 1, 1), date(2020, 1, 6), 5)
