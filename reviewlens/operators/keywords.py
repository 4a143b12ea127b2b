"""How ratings are distributed among the reviews that mention a word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.scalars import rating_level
from reviewlens.functions.tokens import words_in
from reviewlens.operators.ratings import rating_counts, with_share
from reviewlens.schema import RATING_LEVELS


def mentions(df: DataFrame, text: str, keyword: str) -> Column:
    """Whether the keyword is one of the text's words.

    The substring test in front is implied by the word test and spares most texts the tokeniser.
    """
    has_word = F.array_contains(words_in(df, text), keyword)
    if dict(df.dtypes)[text] != "string":
        return has_word
    return F.lower(F.col(text)).contains(keyword) & has_word


def keyword_rating_counts(
    df: DataFrame,
    keyword: str,
    text: str = "text",
    min_chars: int = 1,
    stopwords: list[str] | None = None,
) -> DataFrame:
    """Reviews with the keyword per rating, and their share of all reviews with it.

    A review counts once per rating, however often it has the word. A keyword that is too short or
    a stopword is in no review.
    """
    if len(keyword) < min_chars or keyword in (stopwords or ()):
        hits = df.where(F.lit(False))
    else:
        hits = df.where(mentions(df, text, keyword))
    return with_share(rating_counts(hits.select("id", "rating").distinct()))


def keyword_rating_distribution(
    df: DataFrame, keywords: dict[str, str], text: str = "text"
) -> DataFrame:
    """Rating levels of the reviews with a platform's keyword, for all platforms and levels.

    ``keywords`` names one keyword per platform, in output order. All platforms are read in one
    pass; levels without reviews get a zero, and a platform without any gets zero shares.
    """
    tests = [
        (F.col("platform") == platform) & mentions(df, text, keyword)
        for platform, keyword in keywords.items()
    ]
    hits = df.where(F.col("rating").isNotNull()).where(reduce(lambda a, b: a | b, tests))
    reviews = hits.select("id", "platform", "rating").distinct()
    counts = rating_counts(
        reviews.select("platform", rating_level(F.col("rating"), "truncate").alias("rating")),
        "platform",
    )
    platforms = F.array(*[F.lit(platform) for platform in keywords])
    grid = (
        df.sparkSession.range(1)
        .select(F.explode(platforms).alias("platform"))
        .select(
            "platform",
            F.explode(F.array(*[F.lit(level) for level in RATING_LEVELS])).alias("rating"),
            F.lit(0).cast("long").alias("n"),
        )
    )
    complete = counts.unionByName(grid).groupBy("platform", "rating").agg(F.sum("n").alias("n"))
    order = F.array_position(platforms, F.col("platform")).cast("int").alias("platform_order")
    shares = with_share(complete, "platform", zero=True)
    return shares.select(order, "platform", "rating", "n", "prop")
