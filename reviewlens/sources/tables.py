"""CSV and parquet reading, the canonical review layout, and the sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.scalars import crawl_date, strip, to_date, to_number
from reviewlens.functions.wordlists import (
    ARTICLE_HEADERS,
    CARD_HEADERS,
    FILM_STOPWORDS,
    NORMALISER_STOPWORDS,
    TEXT_COLUMNS,
)
from reviewlens.schema import REVIEW_SCHEMA
from reviewlens.sources.quoted import read_quoted_csv


def read_reviews_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A CSV with header; every column a string, ``NA`` and empty fields null.

    Types are given later by ``harmonise_reviews``, so a bad number or date costs one null and
    not the row. Quoted line breaks need ``multi_line``, which takes two passes over the splits of
    each file; pass False for files without quoted line breaks.
    """
    if multi_line:
        raw = read_quoted_csv(spark, path)
    else:
        raw = (
            spark.read.option("header", True)
            .option("escape", '"')
            .option("encoding", "UTF-8")
            .csv(path)
        )
    return raw.select([_missing_to_null(raw[f"`{name}`"]).alias(name) for name in raw.columns])


def _missing_to_null(value: Column) -> Column:
    return F.when(~value.isin("", "NA"), value)


def harmonise_reviews(
    df: DataFrame,
    platform: str,
    text: str = "content",
    date: str = "date",
    rating: str = "star_rating",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One platform's rows in the canonical layout; vote columns it lacks become typed nulls.

    A column that has its type already is passed on as it is, so filters on it reach the scan.
    """
    types = dict(df.dtypes)

    def votes(name: str) -> Column:
        return F.col(name).try_cast("int") if name in df.columns else F.lit(None).cast("int")

    return df.select(
        F.col("id").cast("string").alias("id"),
        F.lit(platform).alias("platform"),
        (F.col(date) if types[date] == "date" else to_date(F.col(date))).alias("date"),
        to_number(F.col(rating)).alias("rating"),
        F.col(text).alias("text"),
        votes("upvote").alias("upvote"),
        votes("downvote").alias("downvote"),
        *carry,
    )


def union_reviews(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by column name; a column one frame lacks is null there."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=True)
    return result


def standardise_crawl(df: DataFrame, platform: str, layout: str) -> DataFrame:
    """Crawled strings, under either header, as canonical reviews with a stable id.

    The id is a 128-bit digest of platform, author, date and text: the same review crawled twice
    keeps its id, and distinct reviews do not collide at any realistic number of rows.
    """
    headers = {"article": ARTICLE_HEADERS, "card": CARD_HEADERS}.get(layout)
    if headers is None:
        raise ValueError("layout must be 'article' or 'card'")
    renamed = df.withColumnsRenamed({old: new for old, new in headers.items() if old in df.columns})

    def column(name: str) -> Column:
        return F.col(name) if name in renamed.columns else F.lit(None).cast("string")

    parts = [F.lit(platform), column("author"), column("date").cast("string"), column("text")]
    # Lengths in front keep different parts from running together to the same key.
    sized = [F.coalesce(F.concat(F.length(part), F.lit(":"), part), F.lit("-")) for part in parts]
    key = F.concat(*sized)
    return renamed.select(
        F.md5(key).alias("id"),
        F.lit(platform).alias("platform"),
        crawl_date(column("date").cast("string")).alias("date"),
        to_number(column("rating")).alias("rating"),
        column("text").alias("text"),
        column("upvote").try_cast("int").alias("upvote"),
        column("downvote").try_cast("int").alias("downvote"),
        column("author").alias("author"),
        column("title").alias("title"),
    ).select(*REVIEW_SCHEMA.fieldNames(), "author", "title")


def select_text_column(df: DataFrame, candidates: list[str] | None = None) -> DataFrame:
    """``id`` and the first candidate column the frame has, as ``text``."""
    candidates = candidates or TEXT_COLUMNS
    if "id" not in df.columns:
        raise ValueError("the table has no id column")
    for name in candidates:
        if name in df.columns:
            return df.select(F.col("id").cast("string").alias("id"), F.col(name).alias("text"))
    raise ValueError(f"no text column; looked for {', '.join(candidates)}")


def load_texts(df: DataFrame, text: str) -> DataFrame:
    """``id`` and the stripped text, without rows that have none."""
    stripped = strip(F.coalesce(F.col(text), F.lit("")))
    return df.select(F.col("id").cast("string").alias("id"), stripped.alias("text")).where(
        F.col("text") != ""
    )


def merge_normalized(raw: DataFrame, normalized: DataFrame) -> DataFrame:
    """Raw reviews with the text columns of the normaliser, by id."""
    texts = normalized.select(
        F.col("id").cast("string").alias("id"), "original_text", "normalized_text"
    )
    return raw.withColumn("id", F.col("id").cast("string")).join(texts, "id", "left")


def load_stopwords(
    spark: SparkSession, path: str | None = None, defaults: list[str] | None = None
) -> DataFrame:
    """The default words and those of a line-oriented file, once each; a missing file adds none."""
    words = _word_table(spark, NORMALISER_STOPWORDS if defaults is None else defaults)
    if path is not None:
        try:
            lines = spark.read.text(path).select(strip(F.col("value")).alias("word"))
            words = words.union(lines.where(F.col("word") != ""))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return words.distinct()


def english_stopwords(spark: SparkSession) -> DataFrame:
    """Spark's English stopwords as a lexicon table."""
    words = StopWordsRemover.loadDefaultStopWords("english")
    return _word_table(spark, words).withColumn("lexicon", F.lit("english"))


def film_stopwords(spark: SparkSession) -> DataFrame:
    """The film domain list; it belongs to no lexicon."""
    return _word_table(spark, FILM_STOPWORDS).withColumn("lexicon", F.lit(None).cast("string"))


def merge_stopwords(*tables: DataFrame) -> DataFrame:
    """All words once each; a word in several tables keeps the lexicon of the earliest."""
    ordered = [
        table.select("word", "lexicon", F.lit(order).alias("table_order"))
        for order, table in enumerate(tables)
    ]
    row = F.struct("table_order", "lexicon")
    return (
        union_reviews(*ordered)
        .groupBy("word")
        .agg(F.min_by(row, "table_order").getField("lexicon").alias("lexicon"))
    )


def _word_table(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(word) for word in words])).alias("word"))


def write_reviews(
    df: DataFrame, path: str, fmt: str = "csv", partition_by: list[str] | None = None
) -> str:
    """Rows to ``path`` with a header; refuses to write an empty table."""
    if df.isEmpty():
        raise ValueError("there are no reviews to write")
    writer = _text_writer(df, fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_normalized(df: DataFrame, path: str, fmt: str = "csv") -> str:
    """The normaliser's three columns; zero rows give an empty table."""
    columns = df.select("id", "original_text", "normalized_text")
    _text_writer(columns, fmt).save(path)
    return path


def _text_writer(df: DataFrame, fmt: str):
    """A writer that keeps texts as they are, blanks at their ends included."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt != "csv":
        return writer
    return (
        writer.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
    )
