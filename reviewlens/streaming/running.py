"""Running counts of arriving reviews: state per platform and day, upserted batch by batch.

The stream keeps one row of sums per platform and event day, however many reviews there are, so its
state is bounded by the calendar and needs no watermark to be evicted by: a row that comes late, by
days or by years, is counted like any other, and the files may arrive in any order and be cut into
batches in any way. Each micro-batch writes the rows it changed, whole, to a folder named after it;
a batch that is repeated after a failure overwrites its own folder with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.scalars import floor_period
from reviewlens.storage import read_if_exists

SUMS = "platform string, date date, n long, n_rated long, total double, total_squares double"
_NAMES = ["platform", "date", "n", "n_rated", "total", "total_squares"]


def daily_sums(reviews: DataFrame) -> DataFrame:
    """What trends need of a day's reviews (``SUMS``); streams and tables alike.

    A null rating counts to n alone; reviews without a platform or date are groups of their own.
    """
    rating = F.col("rating").cast("double")
    return reviews.groupBy("platform", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(rating).alias("n_rated"),
        F.coalesce(F.sum(rating), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum(rating * rating), F.lit(0.0)).alias("total_squares"),
    )


def count_arrivals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_batch: int = 1000,
) -> None:
    """Counts the reviews of the files that arrived in ``source`` since the last run, then returns.

    The files hold platform, date and rating; other columns are not read. ``target`` and
    ``checkpoint`` belong together and on shared storage: the checkpoint has the state and the
    numbers of the batches, the target what ``read_running`` reads.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    reviews = reader.format(fmt).load(source).select("platform", "date", "rating")

    def upsert(changed: DataFrame, batch: int) -> None:
        folder = f"{target.rstrip('/')}/batches/batch={batch}"
        changed.select(*_NAMES).write.mode("overwrite").parquet(folder)

    query = (
        daily_sums(reviews)
        .writeStream.outputMode("update")
        .foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_running(spark: SparkSession, target: str) -> DataFrame:
    """The sums (``SUMS``) after the last batch; no rows before the first one.

    Of each platform and day the row of the latest batch counts. What a snapshot holds is not read
    again from the batches before it.
    """
    root = target.rstrip("/")
    rows = spark.createDataFrame([], f"{SUMS}, batch long")
    if read_if_exists(spark, f"{root}/batches") is not None:
        rows = spark.read.schema(f"{SUMS}, batch long").parquet(f"{root}/batches")
    if read_if_exists(spark, f"{root}/snapshots") is not None:
        kept = spark.read.schema(f"{SUMS}, batch long").parquet(f"{root}/snapshots")
        last = kept.agg(F.max("batch")).first()[0]
        if last is not None:
            rows = rows.where(F.col("batch") > last).unionByName(kept.where(F.col("batch") == last))
    own = F.struct("n", "n_rated", "total", "total_squares")
    latest = rows.groupBy("platform", "date").agg(F.max_by(own, "batch").alias("own"))
    return latest.select("platform", "date", "own.*")


def compact(spark: SparkSession, target: str) -> None:
    """Writes the present sums as a snapshot, so that reading stays as cheap however many batches.

    To be called between runs. The batch folders stay: whoever reads while this runs finds either
    the older snapshot with all batches after it, or the new one.
    """
    root = target.rstrip("/")
    if read_if_exists(spark, f"{root}/batches") is None:
        return
    batches = spark.read.schema(f"{SUMS}, batch long").parquet(f"{root}/batches")
    last = batches.agg(F.max("batch")).first()[0]
    if last is not None:
        read_running(spark, root).write.mode("overwrite").parquet(f"{root}/snapshots/batch={last}")


def running_trend(
    running: DataFrame, unit: str = "month", min_n: int = 5, with_sd: bool = False
) -> DataFrame:
    """As ``rating_trend``, from the daily sums."""
    if unit not in ("month", "week", "day"):
        raise ValueError("unit must be 'month', 'week' or 'day'")
    period = floor_period(F.col("date"), unit).alias("period")
    sums = running.groupBy("platform", period).agg(*[F.sum(name).alias(name) for name in _NAMES[2:]])
    mean = F.try_divide("total", "n_rated")
    measures = [mean.alias("mean_rating")]
    if with_sd:
        # Never below nought, where rounding of the sums would put it.
        spread = F.greatest(F.col("total_squares") - F.col("total") * mean, F.lit(0.0))
        deviation = F.when(F.col("n_rated") > 1, F.sqrt(spread / (F.col("n_rated") - 1)))
        measures.append(deviation.alias("sd_rating"))
    return sums.where(F.col("n") >= min_n).select("platform", "period", *measures, "n")


def running_quarters(running: DataFrame) -> DataFrame:
    """As ``quarter_counts``, from the daily sums."""
    quarter = floor_period(F.col("date"), "quarter").alias("period_q")
    return running.groupBy("platform", quarter).agg(F.sum("n").alias("n"))
