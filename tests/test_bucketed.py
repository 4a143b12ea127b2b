"""Tables stored by id: same rows as the plain join, and no exchange."""

import uuid

from pyspark.sql import functions as F

from reviewlens.operators.bucketed import first_vectors, join_by_id, save_by_id
from reviewlens.operators.embeddings import load_embeddings
from reviewlens.storage import scratch_path


def saved(spark, df, buckets=8):
    name = f"t_{uuid.uuid4().hex}"
    return save_by_id(df, name, scratch_path(spark, name), buckets)


def tables(spark):
    reviews = spark.range(500).select(
        (F.col("id") % 400).cast("string").alias("id"), F.lit("alpha").alias("platform"), F.col("id").alias("n")
    ).unionByName(spark.createDataFrame([(None, "beta", -1)], "id string, platform string, n long"))
    vectors = spark.range(900).select(
        (F.col("id") % 300).cast("string").alias("id"), F.col("id").alias("vec"),
        F.when(F.col("id") % 300 != 7, F.array(F.sin("id").cast("float"), F.cos("id").cast("float"))).alias("embedding"),
    ).unionByName(spark.createDataFrame([("3", 5000, None), (None, 1, [1.0, 0.0])], "id string, vec long, embedding array<float>"))
    return reviews, vectors


def rows_of(df):
    return sorted(map(str, df.select("id", "platform", "n", "embedding").collect()))


def test_equals_the_plain_join(spark):
    reviews, vectors = tables(spark)
    for position in (None, "vec"):
        names = saved(spark, reviews), saved(spark, first_vectors(vectors, position))
        expected = rows_of(load_embeddings(reviews, vectors, position))
        assert rows_of(join_by_id(spark, *names)) == expected and len(expected) == 400


def test_nothing_is_exchanged(spark):
    reviews, vectors = tables(spark)
    one, two = saved(spark, reviews), saved(spark, first_vectors(vectors))
    joined = join_by_id(spark, one, two)
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert plan.count("Bucketed: true") >= 1
    files = spark.table(one).inputFiles()
    assert len(files) == len({f.rsplit("_", 1)[1] for f in files}) == 8
    # Another number of buckets is right, too, at the cost of an exchange.
    other = saved(spark, first_vectors(vectors), buckets=5)
    assert rows_of(join_by_id(spark, one, other)) == rows_of(joined)


def test_empty_tables(spark):
    reviews, vectors = tables(spark)
    one, two = saved(spark, reviews.limit(0)), saved(spark, first_vectors(vectors))
    assert join_by_id(spark, one, two).count() == 0
