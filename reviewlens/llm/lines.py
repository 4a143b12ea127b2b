"""Removal of lines that stand in many documents, with counts kept in levelled sorted runs.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.text import whole_text
from reviewlens.storage import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _hashes(key: Column) -> list[Column]:
    """Two independent 64-bit hashes stand for a line wherever lines travel."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


class LineRuns:
    """Line counts in sorted runs, in levels as of a log-structured merge tree.

    Every batch adds one run at level 0: parquet, ordered by hash over its files. When a level holds
    ``fanout`` runs, they are merged into a single run of the next level. A run maps a line's hashes
    to the number of documents that were counted for it. Runs live below the session's shared
    folder, so a lost executor costs a re-read only; a merged run is written before it replaces
    the old ones.
    """

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4, path: str | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = path or scratch_path(spark, "line-runs")
        self.levels: list[list[str]] = []
        self.written = 0

    def counts(self) -> DataFrame:
        """(h1, h2, n_docs) over all runs."""
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, n_docs long")
        return self.spark.read.parquet(*runs).groupBy("h1", "h2").agg(
            F.sum("n_docs").alias("n_docs")
        )

    def frequent(self) -> DataFrame:
        """Hashes of the lines counted in at least ``min_docs`` documents."""
        return self.counts().where(F.col("n_docs") >= self.min_docs).select("h1", "h2")

    def add(self, batch: DataFrame) -> None:
        """Counts a batch of (h1, h2, n_docs).

        Lines that the runs already hold as frequent are taken out by a merge anti join: nothing
        more needs to be known about them. The rest becomes a run of its own.
        """
        if self.levels:
            batch = batch.join(self.frequent().hint("merge"), ["h1", "h2"], "left_anti")
        self._store(batch, 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            merged = self.spark.read.parquet(*self.levels[level])
            old, self.levels[level] = self.levels[level], []
            sums = merged.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))
            self._store(sums, level + 1)
            for run in old:
                self._delete(run)
            level += 1

    def _store(self, rows: DataFrame, level: int) -> None:
        run = f"{self.path}/level-{level}/run-{self.written}"
        self.written += 1
        ordered = rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2")
        ordered.write.parquet(run)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _delete(self, run: str) -> None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(run)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def count_lines(
    docs: DataFrame, min_docs: int, min_chars: int = 1, n_batches: int = 4, fanout: int = 4
) -> LineRuns:
    """The runs after all documents were added in ``n_batches`` batches.

    The texts are read once: each batch's counts are combined in the tasks that read them and
    stored by batch, so that only hashes and counts travel.
    """
    spark = docs.sparkSession
    lines = F.split(whole_text(), "\n", -1)
    keys = F.array_distinct(F.transform(lines, line_key))
    each = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_batches)).cast("int").alias("batch"),
        F.explode(keys).alias("key"),
    ).where(F.char_length("key") >= min_chars)
    counts = each.groupBy("batch", *_hashes(F.col("key"))).agg(F.count(F.lit(1)).alias("n_docs"))
    path = scratch_path(spark, "line-batches")
    counts.write.partitionBy("batch").parquet(path)
    stored = spark.read.schema("h1 long, h2 long, n_docs long, batch int").parquet(path)
    runs = LineRuns(spark, min_docs, fanout)
    for batch in range(n_batches):
        runs.add(stored.where(F.col("batch") == batch).drop("batch"))
    return runs


def drop_frequent_lines(
    docs: DataFrame,
    min_docs: int = 10,
    min_chars: int = 1,
    n_batches: int = 4,
    fanout: int = 4,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Documents without the lines whose key stands in at least ``min_docs`` of them.

    ``docs`` needs doc_id and text. Result: doc_id, text (the other lines, joined by line breaks),
    n_lines, n_dropped, and the columns to ``carry``, one row per row of ``docs``. A line's key has no white space at its ends and
    A-Z in lower case; keys below ``min_chars`` code points are never dropped. Lines are split at
    \\n only.

    Null and empty texts are one empty line. Every row counts as a document of its own, also when
    a doc_id or a whole row comes twice; a null doc_id is a value like any other. Other columns
    are ignored unless carried, and may have any names. No documents, no rows. A line that a third of the documents share is one row per task when counted; where it is looked up,
    adaptive execution splits it.
    """
    carried = F.struct(F.lit(0).alias("_"), *[F.col(f"`{name}`") for name in carry])
    docs = docs.select("doc_id", "text", carried.alias("carried"))
    frequent = count_lines(docs, min_docs, min_chars, n_batches, fanout).frequent()
    # Equal rows have equal lines, so the id and the text's hash identify what to drop.
    keyed = docs.withColumn("content", F.xxhash64(F.lit(2), whole_text()))
    lines = F.split(whole_text(), "\n", -1)
    places = keyed.select("doc_id", "content", F.posexplode(lines).alias("pos", "line")).select(
        "doc_id", "content", "pos", *_hashes(line_key(F.col("line")))
    )
    found = places.join(frequent, ["h1", "h2"]).select(
        F.col("doc_id").alias("id"), F.col("content").alias("same"), "pos"
    )
    drops = found.groupBy("id", "same").agg(F.collect_set("pos").alias("drop"))
    joined = keyed.join(
        drops, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("same")), "left"
    ).select("doc_id", lines.alias("lines"), "text", "drop", "carried")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.array_join(F.transform(kept, lambda k: F.col("lines")[k]), "\n")
    return joined.select(
        "doc_id",
        F.when(F.col("drop").isNull(), whole_text()).otherwise(text).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col("carried").getField(name).alias(name) for name in carry],
    )
