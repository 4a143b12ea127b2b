"""Reviews and embeddings stored by id, so that every later join of the two moves no rows.

Both tables are written in the same number of buckets by the hash of the id, each bucket one sorted
file. The price, one shuffle each, is paid when they are stored. The catalog knows the buckets, so a
join on id reads bucket by bucket, and neither side is exchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.embeddings import l2_normalize

BUCKETS = 64


def first_vectors(embeddings: DataFrame, position: str | None = None) -> DataFrame:
    """One vector for each id: the first by ``position``, else the least; null only without another.

    Combined before the shuffle, so an id that is repeated very often is one row per task.
    """
    order = F.col("embedding") if position is None else F.struct(position, "embedding")
    first = F.min_by("embedding", F.when(F.col("embedding").isNotNull(), order))
    return embeddings.groupBy(F.col("id").cast("string").alias("id")).agg(first.alias("embedding"))


def save_by_id(df: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> str:
    """The rows as table ``name`` of the catalog, bucketed and sorted by id, with its files at ``path``.

    An existing table of that name is replaced. Rows of one id lie in one bucket; rows without an id
    are kept, and no join finds them.
    """
    rows = df.withColumn("id", F.col("id").cast("string"))
    dealt = rows.repartition(buckets, "id").sortWithinPartitions("id")
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, "id").sortBy("id").saveAsTable(name)
    return name


def join_by_id(spark: SparkSession, reviews: str, embeddings: str) -> DataFrame:
    """As ``load_embeddings``, for two tables of ``save_by_id``, whose vectors are ``first_vectors``.

    With the same number of buckets on both sides there is no exchange of either; with different
    numbers Spark shuffles one of them.
    """
    vectors = spark.table(embeddings).select("id", "embedding")
    return l2_normalize(spark.table(reviews).join(vectors.hint("merge"), "id"))
