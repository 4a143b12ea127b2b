"""Properties of the operators on generated reviews."""

from datetime import date, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reviewlens.operators import ratings, timesplit, words

FEW = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
RATING = st.one_of(st.none(), st.integers(0, 11).map(float), st.sampled_from([7.5, 3.2]))
DAY = st.one_of(st.none(), st.integers(0, 400).map(lambda d: date(2020, 1, 1) + timedelta(d)))
REVIEW = st.tuples(st.sampled_from(["alpha", "beta"]), DAY, RATING)
REVIEWS = st.lists(REVIEW, min_size=1, max_size=40)
TEXTS = st.lists(st.text("abc ,.'é가1_", max_size=30), min_size=1, max_size=15)


def frame(spark, rows):
    numbered = [(str(i), *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(numbered, "id string, platform string, date date, rating double")


@FEW
@given(REVIEWS)
def test_shares_sum_to_one(spark, rows):
    df = frame(spark, rows)
    for fractional in ("null", "truncate"):
        shares = ratings.rating_distribution(df, fractional).groupBy("platform").agg(F.sum("prop"))
        assert all(total == pytest.approx(1) for _, total in shares.collect())
    normalised = timesplit.early_late_normalised(df, "2020-07-01")
    for group, name in (("phase", "prop_phase"), ("rating", "prop_norm")):
        sums = normalised.groupBy("platform", group).agg(F.sum(name).alias("total")).collect()
        assert all(row.total == pytest.approx(1) for row in sums)


@FEW
@given(REVIEWS, st.sampled_from([0.0, 0.3, 0.5, 1.0]))
def test_split_covers_all_rows(spark, rows, share):
    labels = timesplit.early_late_split(frame(spark, rows), share).collect()
    assert len(labels) == len(rows)
    dates = sorted(day for _, day, _ in rows if day is not None)
    early = sum(row.period_group == "early" for row in labels)
    assert sum(row.period_group is None for row in labels) == len(rows) - len(dates)
    if dates:
        assert early >= share * len(dates) - 1e-9 and labels[0].cutoff_date in dates


@FEW
@given(TEXTS, st.lists(st.sampled_from(["a", "b", "ab", "가", "1"]), max_size=3))
def test_both_forms_of_stopword_removal_agree(spark, texts, stop):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    table = spark.createDataFrame([(w,) for w in stop], "word string")
    inline = words.remove_stopwords(df, stop, keep_empty=True)
    joined = words.remove_stopwords(df, table, keep_empty=True)
    expected = sorted(map(tuple, inline.collect()))
    assert sorted(map(tuple, joined.collect())) == expected
    dropped = words.remove_stopwords(df, table)
    assert sorted(map(tuple, dropped.collect())) == [row for row in expected if row[2]]


@FEW
@given(TEXTS, st.integers(1, 4))
def test_top_words_are_all_words_above_the_rest(spark, texts, k):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    counts = words.word_frequency(df.withColumn("rating", F.lit(1.0)), char_class=None, min_chars=1)
    every = [(row.n, row.word) for row in counts.collect()]
    assert every == sorted(every, key=lambda item: (-item[0], item[1]))
    top = {row.word for row in words.top_words(counts, k).collect()}
    least = every[min(k, len(every)) - 1][0] if every else 0
    assert top == {word for n, word in every if n >= least}
