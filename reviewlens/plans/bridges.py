"""The test tables seen as review tables, in Spark and as SQL for the oracle.

Each SQL text below is plain enough to be read by both engines, so a view means the same rows on
either side. Platform ``alpha`` is the English part of the documents, ``beta`` the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.sources.tables import harmonise_reviews, union_reviews

SOURCE_A = """
SELECT doc_id AS id, DATE '2019-01-01' + CAST(doc_id * 37 % 1800 AS INT) AS date,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 1 + n_chars % 10 END AS star_rating,
       text AS content
FROM documents WHERE lang = 'en'
"""

SOURCE_B = """
SELECT doc_id AS id, DATE '2019-01-01' + CAST(doc_id * 37 % 1800 AS INT) AS writing_date,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 1 + n_chars % 10 END AS star_rating,
       text AS comment, doc_id % 13 AS upvote, doc_id % 5 AS downvote
FROM documents WHERE lang IS DISTINCT FROM 'en'
"""

REVIEWS = """
SELECT CAST(doc_id AS VARCHAR(20)) AS id,
       CASE WHEN lang = 'en' THEN 'alpha' ELSE 'beta' END AS platform,
       DATE '2019-01-01' + CAST(doc_id * 37 % 1800 AS INT) AS date,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE CAST(1 + n_chars % 10 AS DOUBLE) END AS rating,
       text,
       CASE WHEN lang IS DISTINCT FROM 'en' THEN CAST(doc_id % 13 AS INT) END AS upvote,
       CASE WHEN lang IS DISTINCT FROM 'en' THEN CAST(doc_id % 5 AS INT) END AS downvote
FROM documents
"""

# Larger, without text; half stars and ratings off the scale occur.
RATINGS = """
SELECT CAST(o_orderkey AS VARCHAR(20)) AS id,
       CASE o_orderstatus WHEN 'F' THEN 'alpha' ELSE 'beta' END AS platform,
       CAST(o_orderdate AS DATE) AS date,
       CASE WHEN o_orderkey % 19 = 0 THEN NULL
            ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 23 AS DOUBLE) / 2e0 END AS rating
FROM orders
"""

VECTORS = """
SELECT CAST(vec_id AS VARCHAR(20)) AS id,
       CASE WHEN vec_id % 2 = 0 THEN 'alpha' ELSE 'beta' END AS platform,
       CAST(label + 1 AS DOUBLE) AS rating, embedding
FROM embeddings
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _over(spark: SparkSession, folder: str, sql: str, name: str) -> DataFrame:
    """The SQL text with its one table bound to a frame."""
    bound = sql.replace(f"FROM {name}", "FROM {source}")
    return spark.sql(bound, source=table(spark, folder, name))


def source_a(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, folder, SOURCE_A, "documents")


def source_b(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, folder, SOURCE_B, "documents")


def reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Both sources harmonised and united."""
    alpha = harmonise_reviews(source_a(spark, folder), "alpha")
    beta = harmonise_reviews(source_b(spark, folder), "beta", text="comment", date="writing_date")
    return union_reviews(alpha, beta)


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, folder, RATINGS, "orders")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, folder, VECTORS, "embeddings")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors that have a review, with two of their components as coordinates."""
    return vectors(spark, folder).join(reviews(spark, folder), "id", "left_semi").withColumns(
        {
            "dim1": F.col("embedding")[0].cast("double"),
            "dim2": F.col("embedding")[1].cast("double"),
        }
    )
