"""Incremental text normalisation: each new input file is normalised once and appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from reviewlens.operators.normalise import Analyser, normalize_reviews
from reviewlens.sources.tables import select_text_column


def normalize_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    target: str,
    checkpoint: str,
    fmt: str = "csv",
    make_analyser: Callable[[], Analyser] | None = None,
    stopwords: list[str] | None = None,
    files_per_batch: int = 1000,
    multi_line: bool = True,
) -> None:
    """Normalises the files that arrived in ``source`` since the last run, then returns.

    A backlog is worked off ``files_per_batch`` files at a time, so a failure repeats one batch
    and not the whole run. The checkpoint folder remembers which files are done; target and
    checkpoint belong on shared storage. The output is parquet: id, original, normalised text.
    CSV fields with line breaks need ``multi_line``, which reads each file in one task.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
        reader = reader.option("multiLine", multi_line)
    texts = select_text_column(reader.format(fmt).load(source))
    query = (
        normalize_reviews(texts, "text", make_analyser, stopwords)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
