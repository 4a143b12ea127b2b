"""Where intermediate tables go, and how lineage is cut.

Everything here lives in the folder the session names in ``spark.checkpoint.dir``, which on a
cluster is shared storage: a table written there outlives the executor that wrote it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session, which has to be configured."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/reviewlens/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are fixed once, whoever recomputes later."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """The rows as a table in the shared folder, for loops that join their own last result.

    Spark carries the estimated size of a checkpointed plan on, and estimates of joins multiply from
    round to round; of a table it knows the size. Parquet's writer looks at its memory only every 100 rows, and
    its reader takes thousands of rows at a time: rows of many MB need ``rows_per_file`` (0: any number).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """The parquet table at ``path``, or None when there is none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
