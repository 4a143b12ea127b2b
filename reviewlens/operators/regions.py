"""Points stored along an interleaved-bit key, so that a rectangle is read from few files.

Both coordinates are cut into 2**bits cells; the key takes their bits in turn, so points that lie
close together mostly have close keys. Points are range-partitioned and sorted by key. A rectangle is
broken into intervals of keys: quarters of the plane that lie inside are one interval each, those at
its edge are quartered again. Files that no interval meets are not opened, and within a file the
intervals are pushed to the row groups; the rectangle itself is tested on what is left.
"""

from __future__ import annotations

import math
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.filters import in_region

BITS = 24
# Intervals a rectangle is broken into, about; more of them enclose it more closely.
INTERVALS = 64
ROWS_PER_FILE = 4_000_000

Bounds = tuple[float, float]


def _spread(value: Column) -> Column:
    """The bits of a number below 2**31, with a gap behind each."""
    for shift, mask in (
        (16, 0x0000FFFF0000FFFF),
        (8, 0x00FF00FF00FF00FF),
        (4, 0x0F0F0F0F0F0F0F0F),
        (2, 0x3333333333333333),
        (1, 0x5555555555555555),
    ):
        value = value.bitwiseOR(F.shiftleft(value, shift)).bitwiseAND(F.lit(mask))
    return value


def cell(value: Column, bounds: Bounds, bits: int = BITS) -> Column:
    """The cell of a coordinate; what lies outside the bounds counts to the first or last one."""
    low, high = bounds
    size = high - low
    share = (value - low) / size if size > 0 else F.lit(0.0)
    place = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * float(1 << bits))
    return F.least(place, F.lit((1 << bits) - 1))


def cell_number(value: float, bounds: Bounds, bits: int = BITS) -> int:
    """As ``cell``, by the same steps on the driver."""
    low, high = bounds
    share = (value - low) / (high - low) if high - low > 0 else 0.0
    return min(math.floor(max(0.0, min(1.0, share)) * float(1 << bits)), (1 << bits) - 1)


def point_key(x: Column, y: Column, x_bounds: Bounds, y_bounds: Bounds, bits: int = BITS) -> Column:
    """The interleaved cells of a point; null where a coordinate is missing or undefined."""
    known = x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
    key = _spread(cell(x, x_bounds, bits)).bitwiseOR(F.shiftleft(_spread(cell(y, y_bounds, bits)), 1))
    return F.when(known, key)


def key_intervals(
    x_cells: tuple[int, int], y_cells: tuple[int, int], bits: int = BITS, most: int = INTERVALS
) -> list[tuple[int, int]]:
    """Closed intervals of keys that cover a rectangle of cells, in order and apart.

    Squares are quartered level by level while there are fewer than ``most``; a square at the edge
    that is not quartered any more counts whole, so the intervals may cover more, never less.
    """
    (x0, x1), (y0, y1) = x_cells, y_cells
    if x0 > x1 or y0 > y1:
        return []
    done, edge, size = [], [(0, 0, 0)], bits
    while edge and size >= 0:
        following = []
        for code, a, b in edge:
            width = 1 << size
            if a > x1 or b > y1 or a + width <= x0 or b + width <= y0:
                continue
            inside = a >= x0 and b >= y0 and a + width - 1 <= x1 and b + width - 1 <= y1
            if inside or size == 0:
                done.append((code << 2 * size, ((code + 1) << 2 * size) - 1))
            else:
                following.append((code, a, b))
        if len(done) + len(following) >= most or not following:
            done += [(code << 2 * size, ((code + 1) << 2 * size) - 1) for code, _, _ in following]
            break
        size -= 1
        half = 1 << size
        edge = [
            (4 * code + part, a + half * (part & 1), b + half * (part >> 1))
            for code, a, b in following
            for part in range(4)
        ]
    merged: list[tuple[int, int]] = []
    for low, high in sorted(done):
        if merged and low == merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], high)
        else:
            merged.append((low, high))
    return merged


def write_points(
    df: DataFrame,
    path: str,
    x: str = "dim1",
    y: str = "dim2",
    bits: int = BITS,
    parts: int | None = None,
    rows_per_file: int = ROWS_PER_FILE,
) -> None:
    """The points by key below ``path``, with the range of keys of each file.

    ``parts`` is the number of ranges (the session's shuffle partitions). Any number of points at one
    place is spread over several files. Points without a place are kept, but are in no region. A
    point's other columns must not be called ``key``.
    """
    spark, root = df.sparkSession, path.rstrip("/")
    places = [F.min(x), F.max(x), F.min(y), F.max(y)]
    usable = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < math.inf) & (F.abs(y) < math.inf)
    edges = [0.0 if v is None else float(v) for v in df.where(usable).agg(*places).first()]
    x_bounds, y_bounds = (edges[0], edges[1]), (edges[2], edges[3])
    keyed = df.withColumn("key", point_key(F.col(x).cast("double"), F.col(y).cast("double"), x_bounds, y_bounds, bits))
    # Points of one place are told apart by the hash of all they hold.
    order = ["key", F.xxhash64(*df.columns)]
    dealt = keyed.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions("key")
    dealt.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/points")
    stored = spark.read.parquet(f"{root}/points").select("key", F.col("_metadata.file_path").alias("file"))
    ranges = stored.groupBy("file").agg(
        F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    ranges.write.parquet(f"{root}/files")
    row = spark.range(1).select(
        *[F.lit(v).cast("double").alias(n) for v, n in zip(edges, ("x0", "x1", "y0", "y1"))],
        F.lit(bits).alias("bits"),
    )
    row.write.parquet(f"{root}/bounds")


def files_of_region(
    spark: SparkSession, path: str, region: tuple[float, float, float, float]
) -> tuple[DataFrame, list[tuple[int, int]]]:
    """The files (file, low, high, rows) that may hold points of a rectangle, and its intervals."""
    root = path.rstrip("/")
    b = spark.read.parquet(f"{root}/bounds").first()
    x_low, x_high, y_low, y_high = region
    xs, ys, bits = (b["x0"], b["x1"]), (b["y0"], b["y1"]), b["bits"]
    intervals = []
    if x_low <= x_high and y_low <= y_high:
        intervals = key_intervals(
            (cell_number(x_low, xs, bits), cell_number(x_high, xs, bits)),
            (cell_number(y_low, ys, bits), cell_number(y_high, ys, bits)),
            bits,
        )
    meets = F.lit(False)
    for low, high in intervals:
        meets = meets | ((F.col("low") <= high) & (F.col("high") >= low))
    return spark.read.parquet(f"{root}/files").where(meets), intervals


def read_region(
    spark: SparkSession,
    path: str,
    x_low: float,
    x_high: float,
    y_low: float,
    y_high: float,
    x: str = "dim1",
    y: str = "dim2",
) -> DataFrame:
    """The stored points in the closed rectangle, as ``select_region`` finds them, from few files.

    The driver gets the names of the files to be read, as any scan of them would list.
    """
    files, intervals = files_of_region(spark, path, (x_low, x_high, y_low, y_high))
    points = f"{path.rstrip('/')}/points"
    schema = spark.read.parquet(points).schema
    names = [unquote(row["file"]) for row in files.select("file").collect()]
    if not names:
        return spark.createDataFrame([], schema).drop("key")
    inside = F.lit(False)
    for low, high in intervals:
        inside = inside | F.col("key").between(low, high)
    found = spark.read.schema(schema).parquet(*names).where(inside)
    return found.where(in_region(x_low, x_high, y_low, y_high, x, y)).drop("key")
