"""Vectors stored by cell, so that the rows most similar to a centre come out of few of them.

Pivots are means of the vectors around a sample; each vector belongs to the cell of its closest pivot.
A cell's vectors are stored in order of their angle to the pivot. By the triangle inequality of angles
a vector's angle to the centre differs from the pivot's angle to it by no more than its own
angle to the pivot, so that cells, and rings of cells, that cannot reach the k-th best are not read.
The answer is that of a scan of all vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.vectors import dot, unit
from reviewlens.storage import stored

# Cells at most: the driver and every task hold one pivot for each.
MOST_CELLS = 8192
# Products of vectors and pivots that a task works out at a time.
PRODUCTS = 4_000_000
# Runs of cell numbers that are pushed to the scan.
RUNS = 32
# What an angle may be off by rounding: the arc cosine loses half the digits near one.
SLACK = 1e-6
ROWS_PER_FILE = 1_000_000

# The cell of vectors without a direction, which are close to nothing.
NOWHERE = -1

Centre = list[float]
# (cell, lowest and highest angle to the pivot) of the vectors to be read.
Rings = list[tuple[int, float, float]]


def _angle(sim: float) -> float:
    return math.acos(max(-1.0, min(1.0, sim)))


def _place(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``df`` with the cell of each vector and its angle to the pivot."""
    shared = df.sparkSession.sparkContext.broadcast(pivots)
    rows_at_once = max(1, PRODUCTS // max(1, len(pivots)))

    @F.pandas_udf("struct<cell:int,away:double>")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.full(len(batch), NOWHERE, np.int32)
            away = np.full(len(batch), np.nan)
            width = shared.value.shape[1]
            usable = np.array([v is not None and len(v) == width for v in batch], bool)
            (rows,) = np.nonzero(usable)
            for start in range(0, len(rows), rows_at_once):
                own = rows[start : start + rows_at_once]
                vectors = np.stack([np.asarray(v, np.float64) for v in batch.iloc[own]])
                own, vectors = (a[np.isfinite(vectors).all(axis=1)] for a in (own, vectors))
                sims = vectors @ shared.value.T
                cell[own] = sims.argmax(axis=1)
                away[own] = np.arccos(np.clip(sims.max(axis=1), -1, 1))
            yield pd.DataFrame({"cell": cell, "away": away})

    return df.withColumn("place", place("embedding")).select(*df.columns, "place.cell", "place.away")


def _sampled(vectors: DataFrame, wanted: int) -> np.ndarray:
    """That many different vectors, by the hash of their components."""
    sample = vectors.groupBy("embedding").agg(F.lit(1)).orderBy(F.xxhash64("embedding"), "embedding")
    return np.array([r["embedding"] for r in sample.select("embedding").limit(wanted).collect()])


def _means(placed: DataFrame, pivots: np.ndarray, branches: int = 16) -> np.ndarray:
    """Each cell's mean at length one; a cell whose mean has no direction keeps its pivot.

    A cell's partial means meet in ``branches`` reducers first, so that a cell which holds most
    vectors is no single task's work.
    """
    mean = F.col("vector")
    parts = (
        placed.where(F.col("cell") != NOWHERE)
        .select("cell", F.pmod(F.xxhash64("embedding", "id"), F.lit(branches)).alias("branch"),
                array_to_vector("embedding").alias("vector"))
        .groupBy("cell", "branch")
        .agg(Summarizer.mean(mean).alias("vector"), F.count(F.lit(1)).cast("double").alias("n"))
    )
    total = parts.groupBy("cell").agg(Summarizer.mean(mean, F.col("n")).alias("vector"))
    moved = pivots.copy()
    for row in total.select("cell", unit(vector_to_array("vector")).alias("mean")).collect():
        if row["mean"] is not None and np.isfinite(row["mean"]).all():
            moved[row["cell"]] = row["mean"]
    return moved


def write_cells(
    df: DataFrame,
    path: str,
    cells: int | None = None,
    rounds: int = 2,
    parts: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """The rows of ``df`` (id, embedding at length one, others) by cell below ``path``.

    ``cells``: how many, the square root of the rows if not given, ``MOST_CELLS`` at most. The pivots
    move to their cells' means ``rounds`` times. Rows are range-partitioned by cell, angle and
    a hash, so that any number of equal vectors is spread over several files. Rows without a usable
    vector (null, an undefined component, another width than the commonest) are kept and
    are close to nothing. Other columns must not be called ``cell`` or ``away``, nor begin with ``ring_``.
    ``path`` must be new.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    # Several passes follow, which shall not work out the vectors again.
    df = stored(df, "cells")
    dotted = dot(F.col("embedding"), F.col("embedding"))
    usable = df.where(F.col("embedding").isNotNull() & dotted.isNotNull() & (dotted < math.inf))
    vectors = usable.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    wanted = min(cells or math.isqrt(vectors.count()) + 1, MOST_CELLS)
    width = vectors.agg(F.mode(F.size("embedding"), deterministic=True)).first()[0]
    vectors = vectors.where(F.size("embedding") == F.lit(width))
    pivots = _sampled(vectors, wanted)
    if not len(pivots):
        pivots = np.zeros((1, 1))
    for _ in range(rounds if width is not None else 0):
        pivots = _means(_place(vectors, pivots), pivots)
    order = ["cell", "away", F.xxhash64("id")]
    dealt = _place(df, pivots).repartitionByRange(*([parts] if parts else []), *order)
    dealt.sortWithinPartitions("cell", "away").write.option("maxRecordsPerFile", rows_per_file).parquet(
        f"{root}/vectors"
    )
    placed = spark.read.parquet(f"{root}/vectors").where(F.col("cell") != NOWHERE)
    placed.groupBy(F.col("_metadata.file_path").alias("file"), "cell").agg(
        F.min("away").alias("low"), F.max("away").alias("high"), F.count(F.lit(1)).alias("rows")
    ).write.parquet(f"{root}/files")
    sizes = spark.read.parquet(f"{root}/files").groupBy("cell").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")
    )
    named = spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(pivots)], "cell int, pivot array<double>")
    sizes.join(named, "cell").write.parquet(f"{root}/cells")


def _runs(numbers: list[int], most: int = RUNS) -> list[tuple[int, int]]:
    """At most ``most`` closed runs that cover the numbers, joined over the smallest gaps."""
    ordered = sorted(numbers)
    gaps = sorted(range(1, len(ordered)), key=lambda k: (ordered[k - 1] - ordered[k], k))
    cuts = sorted(k for k in gaps[: most - 1] if ordered[k] - ordered[k - 1] > 1)
    edges = [0, *cuts, len(ordered)]
    return [(ordered[a], ordered[b - 1]) for a, b in zip(edges, edges[1:]) if a < b]


def read_rings(spark: SparkSession, path: str, rings: Rings) -> DataFrame:
    """The stored rows in the rings, out of the files that hold any of them."""
    root = path.rstrip("/")
    schema = spark.read.parquet(f"{root}/vectors").schema
    # One ring for a cell, so MOST_CELLS of them at most.
    wanted = F.broadcast(
        spark.createDataFrame(rings, "ring_cell int, ring_low double, ring_high double")
    )
    files = spark.read.parquet(f"{root}/files").join(wanted, F.col("cell") == F.col("ring_cell"))
    meets = (F.col("low") <= F.col("ring_high")) & (F.col("high") >= F.col("ring_low"))
    names = [unquote(r["file"]) for r in files.where(meets).select("file").distinct().collect()]
    if not names:
        return spark.createDataFrame([], schema)
    inside = F.lit(False)
    for low, high in _runs([cell for cell, _, _ in rings]):
        inside = inside | F.col("cell").between(low, high)
    rows = spark.read.schema(schema).parquet(*names).where(inside)
    ring = (F.col("cell") == F.col("ring_cell")) & F.col("away").between(F.col("ring_low"), F.col("ring_high"))
    return rows.join(wanted, ring).select(*schema.names)


def _closest(rows: DataFrame, center: Centre, k: int) -> DataFrame:
    """The ``k`` rows with the highest similarity, ties by id; without their vectors."""
    middle = F.array(*[F.lit(x) for x in center])
    others = [c for c in rows.columns if c not in ("embedding", "cell", "away")]
    ranked = rows.select(*others, dot(F.col("embedding"), middle).alias("sim"))
    return ranked.where(F.col("sim").isNotNull()).orderBy(F.desc("sim"), F.asc("id")).limit(k)


def _angles(spark: SparkSession, path: str, center: Centre) -> list[tuple[float, int, float, float, int]]:
    """(angle of the pivot to the centre, cell, low, high, rows) of all cells, closest first."""
    middle = F.array(*[F.lit(x) for x in center])
    cells = spark.read.parquet(f"{path.rstrip('/')}/cells")
    rows = cells.select("cell", "low", "high", "rows", dot(F.col("pivot"), middle).alias("sim"))
    return sorted((_angle(r["sim"]), r["cell"], r["low"], r["high"], r["rows"]) for r in rows.where("sim IS NOT NULL").collect())


def closest_in_cells(
    spark: SparkSession, path: str, center: Centre | None, k: int = 10, first: int = 2
) -> tuple[DataFrame, dict[str, int]]:
    """The ``k`` stored rows most similar to ``center``, with ``sim``, and what was read for them.

    ``center`` has length one; None, the centre of nothing, has no closest rows. The cells whose pivots
    are closest are read first, ``first`` of them and as many as hold ``k`` rows; the k-th
    best similarity there leaves, of every other cell, the ring of angles within which a row may
    still be as similar. Rows and ties are those of ``closest_to_centroid``. The report
    gives the number of cells and rows there are, of cells read at first and later, and of rows in
    the files' parts that were met.
    """
    cells = _angles(spark, path, center) if center is not None else []
    report = {"cells": len(cells), "rows": sum(c[4] for c in cells), "first": 0, "later": 0}
    if not cells or k < 1:
        rows = spark.read.parquet(f"{path.rstrip('/')}/vectors").limit(0)
        return _closest(rows, center or [0.0], 1), report
    nearest, held = 0, 0
    while nearest < len(cells) and (nearest < first or held < k):
        held += cells[nearest][4]
        nearest += 1
    begun: Rings = [(cell, low, high) for _, cell, low, high, _ in cells[:nearest]]
    found = stored(_closest(read_rings(spark, path, begun), center, k), "closest")
    least = found.agg(F.min("sim"), F.count(F.lit(1))).first()
    # With fewer than k, any row may still be among them.
    far = _angle(least[0]) + SLACK if least[1] >= k else math.inf
    later: Rings = []
    for angle, cell, low, high, _ in cells[nearest:]:
        inner, outer = max(low, angle - far), min(high, angle + far)
        if inner <= outer:
            later.append((cell, inner, outer))
    report |= {"first": nearest, "later": len(later)}
    if not later:
        return found.orderBy(F.desc("sim"), F.asc("id")), report
    more = _closest(read_rings(spark, path, later), center, k)
    return found.unionByName(more).orderBy(F.desc("sim"), F.asc("id")).limit(k), report
