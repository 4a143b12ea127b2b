"""Two-dimensional projection of the embeddings."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.vectors import dot
from reviewlens.operators.embeddings import mean_vector
from reviewlens.storage import cut_lineage, read_if_exists


def project_pca(df: DataFrame) -> DataFrame:
    """``id`` with the first two principal components of the centred, unscaled vectors.

    Fitting passes over the data a few times and keeps a dimension-by-dimension matrix; the
    projection itself is two dot products per row. The largest loading of each is made positive.
    """
    vectors = df.where(F.col("embedding").isNotNull()).select(
        "id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    center = mean_vector(vectors).first()
    if center is None:
        return vectors.select("id", F.lit(0.0).alias("dim1"), F.lit(0.0).alias("dim2"))
    features = vectors.select(array_to_vector("embedding").alias("vector"))
    model = PCA(k=2, inputCol="vector", outputCol="projected").fit(features)
    dimensions = []
    for loadings in model.pc.toArray().T:
        loadings = loadings * (1.0 if loadings[abs(loadings).argmax()] > 0 else -1.0)
        weights = F.array(*[F.lit(float(weight)) for weight in loadings])
        offset = float(loadings @ center["mean"])
        dimensions.append(dot(F.col("embedding"), weights) - F.lit(offset))
    return vectors.select("id", dimensions[0].alias("dim1"), dimensions[1].alias("dim2"))


def projection_path(root: str, method: str = "pca", **parameters: object) -> str:
    """Where a projection of this method and these parameters is kept."""
    if method != "pca":
        raise ValueError(f"no projection method {method!r}; only 'pca' is available")
    suffix = "".join(f"_{name}{value}" for name, value in sorted(parameters.items()))
    return f"{root.rstrip('/')}/projection_{method}{suffix}"


def content_fingerprint(df: DataFrame) -> str:
    """A text that changes with any id or vector, whatever the order of the rows.

    The rows' hashes are summed twice over, as two independent 64-bit numbers, beside the count.
    """
    vectors = df.where(F.col("embedding").isNotNull())
    wide = "decimal(38,0)"
    row = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("id", "embedding").cast(wide)).alias("one"),
        F.sum(F.xxhash64(F.lit(1), "id", "embedding").cast(wide)).alias("two"),
    ).first()
    return f"{row['n']}-{row['one'] or 0}-{row['two'] or 0}"


def cached_projection(
    df: DataFrame, root: str, method: str = "pca", **parameters: object
) -> DataFrame:
    """The stored projection of just these vectors and parameters, else a new one, stored for next
    time beside the others."""
    mark = content_fingerprint(df)
    path = f"{projection_path(root, method, **parameters)}/vectors_{mark}"
    if read_if_exists(df.sparkSession, path) is None:
        project_pca(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def attach_projection(
    reviews: DataFrame, projection: DataFrame, with_index: bool = False
) -> DataFrame:
    """Reviews with their coordinates, by id; a row without its counterpart on either side fails.

    ``with_index`` adds ``idx``, the row number in order of platform and id. Coordinates must have
    distinct ids; a second row of an id fails, too. The one full join finds all of that as it runs.
    """
    placed = projection.groupBy("id").agg(
        F.first("dim1").alias("dim1"), F.first("dim2").alias("dim2"), F.count(F.lit(1)).alias("given")
    )
    marked = reviews.withColumn("reviewed", F.lit(True))
    joined = marked.join(placed, "id", "full")

    def complaint(problem: str):
        return F.raise_error(F.concat(F.lit(problem), F.col("id").cast("string"))).cast("boolean")

    fits = (
        F.when(F.col("reviewed").isNull(), complaint("no review for the projected id "))
        .when(F.col("given").isNull(), complaint("no projection for the id "))
        .when(F.col("given") > 1, complaint("several projected rows for the id "))
        .otherwise(True)
    )
    complete = joined.where(fits).select(*reviews.columns, "dim1", "dim2")
    return row_index(complete, "platform", "id") if with_index else complete


def row_index(df: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, 1 to the number of rows in the given order, without a single-task window.

    The rows are sorted once over all partitions and fixed by a checkpoint. The number of a row is
    then its place in its partition plus the rows in the partitions before.
    """
    place = F.monotonically_increasing_id()
    fixed = cut_lineage(df.orderBy(*order).withColumn("place", place))
    partition = F.shiftright("place", 33)
    within = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = fixed.withColumns({"part": partition, "within": within})
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per partition, so this window is small.
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    offsets = sizes.select("part", before.alias("before"))
    indexed = numbered.join(F.broadcast(offsets), "part")
    return indexed.withColumn("idx", F.col("before") + F.col("within") + 1).drop(
        "place", "part", "within", "before"
    )
