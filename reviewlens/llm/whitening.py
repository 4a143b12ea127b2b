"""Whitening of embeddings by exact covariances found from variances alone (polarisation).

Vectors become whole numbers x = floor(scale * c), so every sum below is exact, in any order. With n
distinct vectors and their sums S, the centred value of a dimension is n * x - S, a whole number,
and the sum of its squares is n**2 times that of the ordinary deviations. The squares are summed for
every dimension and for the sum of every two; 2 cov(i, j) = var(i + j) - var(i) - var(j) then gives
all covariances without a product of two dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.text import bounded_batches
from reviewlens.storage import scratch_path

# Centred values that a task squares at a time.
CENTRED = 1 << 18
# Squares travel as three whole numbers of this many bits, the highest of them signed.
LIMB = 60
_PART = 21


def whole_vector(embedding: Column, scale: int = 256) -> Column:
    """Each entry as floor(scale * entry), in double precision; null for a vector that is no use.

    A null vector and one with a null, infinite or undefined entry are no use. Products beyond 64
    bits become the nearest number of 64 bits.
    """
    entries = F.transform(embedding, lambda c: c.cast("double"))
    bad = F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floors = F.transform(entries, lambda c: F.floor(c * F.lit(float(scale))))
    return F.when(embedding.isNotNull() & ~bad, floors)


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of numbers."""
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def centred_rows(rows: np.ndarray, count: int, sums: list[int]) -> np.ndarray:
    """count * x - S, as 64-bit numbers where these and the sum of two of them fit, else unbounded."""
    top = max((abs(int(v)) for v in (rows.min(initial=0), rows.max(initial=0))), default=0)
    if (top + 1) * count * 4 + 2 * max(map(abs, sums), default=0) < 1 << 62:
        return rows * np.int64(count) - np.array(sums, np.int64)
    return rows.astype(object) * count - np.array(sums, object)


def square_sums(values: np.ndarray) -> list[int]:
    """The exact sum of squares of every column.

    64-bit values are taken apart into three parts of 21 bits, so that the sums of products of
    parts stay within 64 bits for the rows of one step.
    """
    if values.dtype == object:
        return [int(v) for v in (values * values).sum(axis=0)] if len(values) else [0] * values.shape[1]
    if max(abs(int(values.min(initial=0))), abs(int(values.max(initial=0)))) < 1 << _PART:
        return [int(v) for v in (values * values).sum(axis=0)]
    mask = np.int64((1 << _PART) - 1)
    parts = [values & mask, (values >> _PART) & mask, values >> (2 * _PART)]
    total = [0] * values.shape[1]
    for a in range(3):
        for b in range(a, 3):
            shift = _PART * (a + b) + (a != b)
            own = (parts[a] * parts[b]).sum(axis=0)
            total = [t + (int(v) << shift) for t, v in zip(total, own)]
    return total


def _limbs(value: int) -> tuple[int, int, int]:
    mask = (1 << LIMB) - 1
    return value & mask, (value >> LIMB) & mask, value >> (2 * LIMB)


def fit_list(x: DataFrame) -> DataFrame:
    """Each distinct vector once; equal ones fall together before they are shuffled."""
    return x.select("x").distinct()


def sums_of(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many vectors there are, and the exact sum of each dimension: one row for the driver."""
    wide = F.col("x")
    own = [F.sum(wide[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    row = vectors.agg(F.count(F.lit(1)).alias("n"), *own).first()
    return row["n"], [int(row[f"s{k}"] or 0) for k in range(width)]


def polarised_squares(vectors: DataFrame, count: int, sums: list[int]) -> np.ndarray:
    """Exact sums of squared centred values: [i, i] for dimension i, [i, j] for the sum of i and j.

    Every task adds up its own rows and passes one line per pair of dimensions on; they are added
    per pair in Spark, and the driver gets one number per pair, whatever the number of rows.
    """
    width = len(sums)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}
        step = max(1, CENTRED // max(width, 1))
        for batch in batches:
            rows = _matrix(batch.column(0))
            for at in range(0, len(rows), step):
                own = centred_rows(rows[at : at + step], count, sums)
                for i in range(width):
                    paired = own[:, i:] + own[:, i, None]
                    paired[:, 0] = own[:, i]
                    for j, value in enumerate(square_sums(paired), i):
                        total[i, j] = total.get((i, j), 0) + value
        keys = list(total)
        limbs = [_limbs(total[key]) for key in keys]
        columns = [[i for i, _ in keys], [j for _, j in keys], *([l[k] for l in limbs] for k in range(3))]
        kinds = [pa.int32()] * 2 + [pa.int64()] * 3
        arrays = [pa.array(column, kind) for column, kind in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "l0", "l1", "l2"])

    parts = vectors.select("x").mapInArrow(add_up, "i int, j int, l0 long, l1 long, l2 long")
    limb_sums = [F.sum(F.col(f"l{k}").cast("decimal(38,0)")).alias(f"l{k}") for k in range(3)]
    squares = np.zeros((width, width), object)
    for row in parts.groupBy("i", "j").agg(*limb_sums).collect():
        squares[row["i"], row["j"]] = sum(int(row[f"l{k}"]) << (LIMB * k) for k in range(3))
    return squares


def cross_products(squares: np.ndarray) -> np.ndarray:
    """Exact sums of products of centred values, by polarisation: (var(i+j) - var(i) - var(j)) / 2."""
    width = len(squares)
    products = np.zeros((width, width), object)
    for i in range(width):
        products[i, i] = squares[i, i]
        for j in range(i + 1, width):
            twice = squares[i, j] - squares[i, i] - squares[j, j]
            products[i, j] = products[j, i] = twice // 2
    return products


@dataclass(frozen=True)
class Whitening:
    """What was fitted: the number of distinct vectors, their sums, and the components by row.

    ``components`` are unit eigenvectors of the covariance, by falling eigenvalue; ``explained`` is
    their share of the trace. A direction without variance, to rounding, has eigenvalue 0.
    """

    count: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def fit_whitening(vectors: DataFrame, width: int, components: int) -> Whitening:
    """Covariances, exact up to the last division, and the first components of their eigenvectors."""
    count, sums = sums_of(vectors, width)
    products = cross_products(polarised_squares(vectors, count, sums))
    scale = count**3
    covariance = np.array([[v / scale for v in row] for row in products], np.float64)
    values, basis = np.linalg.eigh(covariance.reshape(width, width))
    values, basis = values[::-1][:components], basis[:, ::-1].T[:components]
    top = values[0] if len(values) else 0.0
    values = np.where(values > top * width * np.finfo(float).eps, values, 0.0)
    trace = sum(products[i, i] for i in range(width)) / scale if width else 0.0
    explained = values / trace if trace else np.zeros(len(values))
    return Whitening(count, sums, basis, values, explained)


def _whitened(own: np.ndarray, model: Whitening) -> np.ndarray:
    """Centred rows on the components, each divided by its deviation; not defined without variance."""
    with np.errstate(divide="ignore", invalid="ignore"):
        scores = (own.astype(np.float64) / model.count) @ model.components.T
        return np.where(model.eigenvalues > 0, scores / np.sqrt(model.eigenvalues), np.nan)


def identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity.

    Tasks pass on their number of rows, means, and centred products; these merge exactly as if all
    rows had been centred by the common mean. Components without variance are left out.
    """
    alive = np.flatnonzero(model.eigenvalues > 0)
    size = len(alive)
    if not size:
        return None

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = centred_rows(_matrix(batch.column(0)), model.count, model.sums)
                white = _whitened(own, model)[:, alive]
                mean = white.mean(axis=0)
                spread = (white - mean).T @ (white - mean)
                row = [[len(white)], [mean.tolist()], [spread.ravel().tolist()]]
                yield pa.RecordBatch.from_pydict(dict(zip(("n", "mean", "spread"), row)))

    parts = vectors.select("x").mapInArrow(
        add_up, "n long, mean array<double>, spread array<double>"
    )
    first = [F.sum(F.col("n") * F.col("mean")[k]).alias(f"m{k}") for k in range(size)]
    second = [
        F.sum(F.col("spread")[i * size + j] + F.col("n") * F.col("mean")[i] * F.col("mean")[j])
        for i in range(size)
        for j in range(size)
    ]
    row = parts.agg(*first, *(c.alias(f"p{k}") for k, c in enumerate(second))).first()
    mean = np.array([row[f"m{k}"] for k in range(size)]) / model.count
    spread = np.array([row[f"p{k}"] for k in range(size * size)]).reshape(size, size) / model.count
    return float(np.abs(spread - np.outer(mean, mean) - np.eye(size)).max())


def whiten(
    embeddings: DataFrame, components: int = 4, scale: int = 256, width: int | None = None
) -> DataFrame:
    """Every usable vector on the first components of the covariance, at unit variance.

    ``embeddings``: vec_id, embedding; other columns are ignored. Result, a row per vector and
    component: vec_id, component (from 1, by falling eigenvalue), n (distinct whole vectors, which
    alone are fitted to), deviation (sum over dimensions of (n * x - S)**2, exact, decimal),
    whitened, explained, identity_error.

    Vectors that are null or hold a null, infinite or undefined entry have no rows. All vectors must
    have one length: ``width``, or the most frequent one (of equally frequent ones the longest);
    others have no rows either. Repeated rows and ids, also null ones, give rows each. There are
    as many components as dimensions at most. A component without variance, as when all vectors
    are equal, has a null ``whitened`` and an explained share of 0, and identity_error leaves it out.
    No vectors, no rows.

    The driver holds one number per pair of dimensions. Vectors are stored once as whole numbers;
    copies count once in the fit and fall together before they are shuffled.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, "whole-vectors")
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), whole_vector(F.col("embedding"), scale).alias("x")
    ).where(F.col("x").isNotNull())
    rows.write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    if width is None:
        lengths = rows.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
        common = lengths.orderBy(F.desc("n"), F.desc("width")).first()
        width = common["width"] if common else 0
    rows = rows.where(F.size("x") == width)
    fit_list(rows).write.parquet(f"{path}/fit")
    vectors = spark.read.parquet(f"{path}/fit")
    model = fit_whitening(vectors, width, components)
    error = identity_error(vectors, model)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.eigenvalues)
        for batch in batches:
            own = centred_rows(_matrix(batch.column(1)), model.count, model.sums)
            white = _whitened(own, model)
            squares = square_sums(own.T)
            each = np.repeat(np.arange(len(own)), size)
            nth = np.tile(np.arange(size), len(own))
            values = white.ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(nth + 1, pa.int32()),
                    pa.array([str(squares[k]) for k in each], pa.string()),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(model.explained[nth]),
                ],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    projected = rows.mapInArrow(
        project,
        "vec_id long, component int, deviation string, whitened double, explained double",
    )
    return projected.select(
        "vec_id",
        "component",
        F.lit(model.count).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        "explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
