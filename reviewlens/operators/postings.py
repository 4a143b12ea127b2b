"""A stored index from words to reviews, so that a keyword's ratings need no scan of the texts.

A posting says that a review has a word, and carries what lookups ask for: platform, rating, day.
Postings lie in Parquet folders by batch of reviews and by bucket, the hash of the word, sorted by
word within each file. A lookup reads the files of one bucket and, in these, the row groups whose
range of words holds the keyword. Files are cut by ranges of (bucket, word, id), so the postings of
a word that a third of all reviews have are spread over many files and tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.tokens import words_in
from reviewlens.operators.keywords import keyword_rating_counts, keyword_rating_distribution
from reviewlens.storage import read_if_exists

BUCKETS = 64

_POSTING = (
    "id string, platform string, rating double, date date, word string, batch string, bucket int"
)


def bucket_of(word: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a word."""
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def postings_of(df: DataFrame, text: str = "text") -> DataFrame:
    """id, platform, rating, date, word: each word of a review once; no words, no postings."""
    words = F.explode(F.array_distinct(words_in(df, text)))
    rating = F.col("rating").cast("double").alias("rating")
    return df.select("id", "platform", rating, "date", words.alias("word"))


def write_postings(
    df: DataFrame,
    path: str,
    batch: str,
    text: str = "text",
    buckets: int = BUCKETS,
    parts: int | None = None,
) -> None:
    """Adds the reviews of one batch to the index at ``path``.

    A batch that is written again replaces itself, so a failed or repeated run adds nothing twice.
    ``buckets`` must be the same for all batches. ``parts`` is the number of ranges (the session's
    shuffle partitions). Repeated reviews give repeated postings; lookups count an id once.
    """
    if "/" in batch or not batch:
        raise ValueError("a batch is named without slashes")
    rows = postings_of(df, text).withColumn("bucket", bucket_of(F.col("word"), buckets))
    order = ["bucket", "word", "id"]
    ranges = [parts, *order] if parts else order
    dealt = rows.repartitionByRange(*ranges).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite").partitionBy("bucket")
    writer.parquet(f"{path.rstrip('/')}/batch={batch}")


def read_postings(spark: SparkSession, path: str, words: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some words, from their buckets alone; none if nothing was written yet.

    The buckets are worked out before the scan is planned, so the other folders are not listed in it.
    """
    if not words or read_if_exists(spark, path) is None:
        return spark.createDataFrame([], _POSTING)
    hashed = spark.range(1).select(*[bucket_of(F.lit(word), buckets) for word in words]).first()
    stored = spark.read.schema(_POSTING).parquet(path)
    return stored.where(F.col("bucket").isin(sorted(set(hashed))) & F.col("word").isin(words))


def indexed_rating_counts(
    spark: SparkSession,
    path: str,
    keyword: str,
    min_chars: int = 1,
    stopwords: list[str] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """As ``keyword_rating_counts`` over the indexed reviews, without their texts."""
    hits = read_postings(spark, path, [keyword], buckets).withColumn("words", F.array("word"))
    return keyword_rating_counts(hits, keyword, "words", min_chars, stopwords)


def indexed_rating_distribution(
    spark: SparkSession, path: str, keywords: dict[str, str], buckets: int = BUCKETS
) -> DataFrame:
    """As ``keyword_rating_distribution`` over the indexed reviews, without their texts."""
    hits = read_postings(spark, path, sorted(set(keywords.values())), buckets)
    return keyword_rating_distribution(hits.withColumn("words", F.array("word")), keywords, "words")
