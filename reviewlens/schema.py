"""Column layouts shared by the readers and the operators."""

from __future__ import annotations

from pyspark.sql import types as T

REVIEW_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("text", T.StringType()),
        T.StructField("upvote", T.IntegerType()),
        T.StructField("downvote", T.IntegerType()),
    ]
)

REVIEW_COLUMNS = REVIEW_SCHEMA.fieldNames()

# One analysed token of a review: surface form, part-of-speech tag, dictionary form.
ANALYSED_TOKENS = T.ArrayType(
    T.StructType(
        [
            T.StructField("form", T.StringType()),
            T.StructField("tag", T.StringType()),
            T.StructField("lemma", T.StringType()),
        ]
    )
)

EMBEDDING_TYPE = T.ArrayType(T.FloatType())

RATING_LEVELS = list(range(1, 11))
