"""Review embeddings: making, storing, loading, centroids and representatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.scalars import truncate_text
from reviewlens.functions.tokens import word_array
from reviewlens.functions.vectors import dot, let, norm, unit
from reviewlens.operators.ratings import quantiles, rated, rating_counts
from reviewlens.schema import EMBEDDING_TYPE

# texts -> one vector per text, in their order
Embedder = Callable[[list[str]], list[list[float]]]


def embed_texts(
    texts: DataFrame, make_embedder: Callable[[], Embedder] | None = None, batch: int = 32
) -> DataFrame:
    """``id`` and the embedding of ``text``, asked for in batches.

    Without an embedder a hashed bag of words at length one is used, computed in the JVM.
    """
    if make_embedder is None:
        return _hashed_words(texts)

    @F.pandas_udf(EMBEDDING_TYPE)
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder = make_embedder()
        for series in batches:
            vectors: list = []
            for start in range(0, len(series), batch):
                chunk = series.iloc[start : start + batch].tolist()
                answer = embedder(chunk)
                if len(answer) != len(chunk):
                    raise ValueError("the embedder returned another number of vectors than texts")
                vectors.extend(np.asarray(vector, dtype=np.float32) for vector in answer)
            yield pd.Series(vectors, dtype=object)

    return texts.select("id", embed("text").alias("embedding"))


def _hashed_words(texts: DataFrame) -> DataFrame:
    """Counts of the words in 64 buckets, at length one; a bucket is the low six of the first 32 bits of
    the word's MD5. Those are counted by two hexadecimal digits first, which are never made numbers."""
    words = texts.select(
        "id",
        F.transform(word_array(F.col("text")), lambda w: F.substring(F.md5(w), 7, 2)).alias("digits"),
    )
    names = [f"{k:02x}" for k in range(256)]
    counter = CountVectorizerModel.from_vocabulary(names, "digits", "counts")
    counted = counter.transform(words).select("id", vector_to_array("counts").alias("counts"))

    def bucket(k: Column) -> Column:
        return sum((F.get(F.col("counts"), k + 64 * part) for part in range(1, 4)), F.get(F.col("counts"), k))

    buckets = F.transform(F.sequence(F.lit(0), F.lit(63)), bucket)
    scaled = let(buckets, lambda n: F.when(norm(n) > 0, unit(n)).otherwise(n))
    return counted.select("id", scaled.cast(EMBEDDING_TYPE).alias("embedding"))


def quantize_f16(vector: Column) -> Column:
    """The vector after storage in half precision."""

    @F.arrow_udf(EMBEDDING_TYPE)
    def rounded(vectors: pa.Array) -> pa.Array:
        values = vectors.flatten().to_numpy(zero_copy_only=False)
        halves = values.astype(np.float16).astype(np.float32)
        sizes = np.append(0, np.cumsum(np.nan_to_num(vectors.value_lengths().to_numpy(False))))
        return pa.ListArray.from_arrays(
            pa.array(sizes, pa.int32()), pa.array(halves), mask=vectors.is_null()
        )

    return rounded(vector)


def write_embeddings(df: DataFrame, path: str, dimension: int, half: bool = True) -> str:
    """``id`` and embedding to parquet; a missing or odd-sized vector fails the write."""
    checked = F.when(F.size("embedding") == dimension, F.col("embedding").cast(EMBEDDING_TYPE))
    complaint = F.raise_error(F.concat(F.lit("bad embedding for id "), F.col("id").cast("string")))
    vector = F.coalesce(checked, complaint.cast(EMBEDDING_TYPE))
    table = df.select(F.col("id").cast("string").alias("id"), vector.alias("embedding"))
    if half:
        table = table.withColumn("embedding", quantize_f16(F.col("embedding")))
    table.write.mode("overwrite").parquet(path)
    return path


def union_embeddings(*frames: DataFrame) -> DataFrame:
    """All rows of several ``(id, embedding)`` tables."""
    result = frames[0].select("id", "embedding")
    for frame in frames[1:]:
        result = result.unionByName(frame.select("id", "embedding"))
    return result


def load_embeddings(
    reviews: DataFrame, embeddings: DataFrame, position: str | None = None
) -> DataFrame:
    """Reviews that have an embedding, with it at length one.

    Each review comes once: of several vectors of an id the first is used, by ``position`` where that
    column says which comes first, else the least vector, component by component. A null vector
    counts only where an id has no other.
    """
    order = F.col("embedding") if position is None else F.struct(position, "embedding")
    first = F.min_by("embedding", F.when(F.col("embedding").isNotNull(), order))
    lookup = embeddings.groupBy("id").agg(first.alias("embedding"))
    return l2_normalize(reviews.join(lookup, "id"))


def l2_normalize(df: DataFrame) -> DataFrame:
    """Vectors at length one; a zero vector becomes null."""
    return df.withColumn("embedding", unit(F.col("embedding")))


def mean_vector(df: DataFrame, branches: int = 64) -> DataFrame:
    """One row, ``mean``: the mean of the vectors; no row for an empty table.

    The partial means of all tasks meet in ``branches`` reducers first, and then in one.
    """
    vectors = df.where(F.col("embedding").isNotNull()).select(
        F.pmod(F.xxhash64("id"), F.lit(branches)).alias("branch"),
        array_to_vector(F.col("embedding").cast("array<double>")).alias("vector"),
    )
    partial = vectors.groupBy("branch").agg(
        Summarizer.mean(F.col("vector")).alias("vector"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )
    # Grouped by a constant, so that no vectors give no row.
    total = partial.groupBy(F.lit(0).alias("all")).agg(
        Summarizer.mean(F.col("vector"), F.col("n")).alias("mean")
    )
    return total.select(vector_to_array("mean").alias("mean"))


def centroid(df: DataFrame) -> DataFrame:
    """One row: the mean vector at length one; no row for an empty table."""
    return mean_vector(df).select(unit(F.col("mean")).alias("centroid"))


def closest_to_centroid(df: DataFrame, selected: Column | DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` rows of the whole table most similar to the centroid of the selected ones.

    ``selected`` is a test on the table's rows or a table of ids. Vectors must have length one.
    Ties go by id; an empty selection has no closest rows.
    """
    if isinstance(selected, DataFrame):
        chosen = df.join(selected.select("id"), "id", "left_semi")
    else:
        chosen = df.where(selected)
    center = centroid(chosen).scalar()
    similarity = df.withColumn("center", center).select(
        *[c for c in df.columns if c != "embedding"],
        dot(F.col("embedding"), F.col("center")).alias("sim"),
    )
    ranked = similarity.where(F.col("sim").isNotNull())
    return ranked.orderBy(F.desc("sim"), F.asc("id")).limit(k)


def representatives(
    df: DataFrame, reviews: DataFrame, selected: Column | DataFrame, k: int = 10
) -> DataFrame:
    """Platform, rating, rounded similarity and snippet of the rows closest to the selection.

    Most similar first, ties by id. An id without a review keeps its row, with nulls; of several
    reviews of an id, each has a row. Only vectors are ranked; ``reviews`` is cut down to the ``k``
    ids before anything is joined to them.
    """
    return with_reviews(closest_to_centroid(df, selected, k), reviews)


def with_reviews(closest: DataFrame, reviews: DataFrame) -> DataFrame:
    """The representatives table of a few ids with their similarities, as ``representatives`` has it."""
    top = closest.select("id", "sim")
    found = reviews.join(top.select("id"), "id", "left_semi")
    return (
        top.join(found.select("id", "platform", "rating", "text"), "id", "left")
        .orderBy(F.desc("sim"), F.asc("id"))
        .select(
            "id",
            "platform",
            "rating",
            F.bround("sim", 3).alias("sim"),
            truncate_text(F.col("text"), 120).alias("snippet"),
        )
    )


def platform_mix(df: DataFrame) -> DataFrame:
    """Rows per platform."""
    return df.groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


def region_summary(df: DataFrame) -> DataFrame:
    """One row: number of rows, six-number summary of the ratings, and missing ratings."""
    counts = rating_counts(df)
    n_rated = F.sum(rated(F.col("n")))
    summary = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        quantiles([0.25, 0.5, 0.75]).alias("q"),
        F.min("rating").alias("rating_min"),
        F.max("rating").alias("rating_max"),
        F.try_divide(F.sum(F.col("rating") * F.col("n")), n_rated).alias("rating_mean"),
        F.coalesce(F.sum("n") - F.coalesce(n_rated, F.lit(0)), F.lit(0)).alias("n_missing"),
    )
    return summary.select(
        "n",
        "rating_min",
        F.col("q")[0].alias("rating_q1"),
        F.col("q")[1].alias("rating_median"),
        "rating_mean",
        F.col("q")[2].alias("rating_q3"),
        "rating_max",
        "n_missing",
    )
