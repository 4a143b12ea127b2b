"""Edge weights of a neighbour graph and a layout from its Laplacian's eigenvectors.

Weights follow the published construction of fuzzy neighbourhoods: a row's nearest neighbour has
weight 1, weights fall off exponentially with what lies beyond, at a scale found per row so that the
row's weights sum up to log2(k), and the two weights of a pair combine as a + b - a * b.

The layout takes the first eigenvectors of the normalised adjacency after the trivial one. They come
from block power iteration: a product with the matrix is a join of the edges with the vectors and a
sum per row, all in Spark SQL; a polynomial of the matrix is applied in each round, then the block is
made orthogonal. Only products of block columns, a few dozen numbers, reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.storage import stored

# Halvings in the search for a row's scale, and its least value as a share of the mean distance.
HALVINGS = 64
LEAST_SCALE = 1e-3
# Products with the matrix that are planned together.
PRODUCTS = 2


def local_scales(distances: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows of ascending distances: the nearest that is not nought, and the row's scale.

    The scale s solves sum(exp(-max(0, d - nearest) / s)) = log2(k) by bisection, over all rows at
    once; it is bounded below by a share of the row's mean distance.
    """
    inside = np.where(mask, distances, np.inf)
    above = np.where(mask & (distances > 0), distances, np.inf).min(axis=1, initial=np.inf)
    nearest = np.where(np.isinf(above), 0.0, above)
    beyond = np.maximum(inside - nearest[:, None], 0.0)
    target = math.log2(max(k, 2))
    low, high = np.zeros(len(distances)), np.full(len(distances), np.inf)
    scale = np.ones(len(distances))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for _ in range(HALVINGS):
            total = np.where(mask, np.exp(-beyond / scale[:, None]), 0.0).sum(axis=1)
            over = total > target
            high, low = np.where(over, scale, high), np.where(over, low, scale)
            scale = np.where(np.isinf(high), scale * 2, (low + high) / 2)
        mean = np.where(mask, distances, 0.0).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
    return nearest, np.clip(scale, np.maximum(LEAST_SCALE * mean, 1e-12), 1e12)


def directed_weights(graph: DataFrame) -> DataFrame:
    """id, neighbour, weight for each row of a neighbour graph (id, rank, neighbour, sim)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, flat = batch.column(1), batch.column(1).flatten()
            away = flat.field("distance").to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            width = int(sizes.max(initial=0))
            mask = np.arange(width) < sizes[:, None]
            distances = np.zeros(mask.shape)
            distances[mask] = away
            k = batch.column(2).to_numpy()
            weights = np.zeros(mask.shape)
            for own in np.unique(k):
                rows = k == own
                nearest, scale = local_scales(distances[rows], mask[rows], int(own))
                beyond = np.maximum(distances[rows] - nearest[:, None], 0.0)
                weights[rows] = np.exp(-beyond / scale[:, None])
            each = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            columns = [batch.column(0).take(each), flat.field("neighbour"), pa.array(weights[mask])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "neighbour", "weight"])

    distance = F.greatest(F.lit(0.0), 1.0 - F.col("sim")).alias("distance")
    link = F.struct("rank", distance, "neighbour")
    # A row's neighbours are as few as the graph's k.
    rows = graph.groupBy("id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    rows = rows.select("id", "links", F.size("links").alias("k"))
    return rows.mapInArrow(weigh, "id string, neighbour string, weight double")


def fuzzy_weights(graph: DataFrame) -> DataFrame:
    """id, neighbour, weight: symmetric, both directions of a pair as rows.

    Rows without neighbours have no weights. A pair linked in both directions gets a + b - a * b,
    one linked in one direction its weight.
    """
    own = directed_weights(graph)
    ahead = own.select("id", "neighbour", F.col("weight").alias("a"), F.lit(0.0).alias("b"))
    behind = own.select(
        F.col("neighbour").alias("id"), F.col("id").alias("neighbour"), F.lit(0.0).alias("a"), F.col("weight").alias("b")
    )
    both = ahead.unionByName(behind).groupBy("id", "neighbour")
    sums = both.agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select("id", "neighbour", (F.col("a") + F.col("b") - F.col("a") * F.col("b")).alias("weight"))


def normalised(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The adjacency divided by the roots of both degrees (row, col, s), and the degrees."""
    sums = weights.groupBy("id").agg(F.sum("weight").alias("degree"))
    degrees = stored(sums.where(F.col("degree") > 0), "degrees")
    one = degrees.select(F.col("id").alias("row"), F.col("degree").alias("d1"))
    two = degrees.select(F.col("id").alias("col"), F.col("degree").alias("d2"))
    edges = weights.select(F.col("id").alias("row"), F.col("neighbour").alias("col"), "weight")
    scaled = edges.join(one, "row").join(two, "col")
    value = F.col("weight") / F.sqrt(F.col("d1") * F.col("d2"))
    return stored(scaled.select("row", "col", value.alias("s")), "edges"), degrees


@dataclass
class Spectrum:
    """Eigenvectors by falling eigenvalue: ``vectors`` has id and e0, e1, ...; and how they came."""

    vectors: DataFrame
    values: list[float]
    residuals: list[float]
    rounds: int


def _names(prefix: str, size: int) -> list[str]:
    return [f"{prefix}{c}" for c in range(size)]


def _product(edges: DataFrame, state: DataFrame, prefix: str, size: int) -> DataFrame:
    """id and the product of the matrix with the block's columns, as a0, a1, ..."""
    block = state.select(F.col("id").alias("col"), *_names(prefix, size))
    sums = [F.sum(F.col("s") * F.col(f"{prefix}{c}")).alias(f"a{c}") for c in range(size)]
    return edges.join(block, "col").groupBy(F.col("row").alias("id")).agg(*sums)


def _inner(table: DataFrame, pairs: list[tuple[str, str]], size: int) -> list[np.ndarray]:
    """Inner products of all columns of two blocks, for several pairs of blocks, in one pass."""
    sums = [
        F.sum(F.col(f"{one}{i}") * F.col(f"{two}{j}"))
        for one, two in pairs
        for i in range(size)
        for j in range(size)
    ]
    row = table.agg(*[s.alias(f"p{n}") for n, s in enumerate(sums)]).first()
    flat = np.array([row[f"p{n}"] for n in range(len(sums))], float)
    return list(flat.reshape(len(pairs), size, size))


def _turned(prefix: str, matrix: np.ndarray, out: str) -> list[Column]:
    """The block's columns combined by a small matrix."""
    size = len(matrix)
    return [
        sum((F.col(f"{prefix}{i}") * float(matrix[i, j]) for i in range(size)), F.lit(0.0)).alias(f"{out}{j}")
        for j in range(matrix.shape[1])
    ]


def eigenvectors(
    weights: DataFrame,
    count: int = 3,
    extra: int = 5,
    degree: int = 12,
    rounds: int = 40,
    tolerance: float = 1e-6,
) -> Spectrum:
    """The first ``count`` eigenvectors of the normalised adjacency, those of the Laplacian from below.

    A round applies a Chebyshev polynomial of ``degree`` that damps everything between -1 and the
    last value of the block (``count + extra`` columns), then makes the block orthogonal and rotates
    it (Rayleigh-Ritz). It ends when all residuals |Av - qv| are at most ``tolerance``, or after
    ``rounds``. Each of the ``degree`` products of a round moves one row of ``count + extra``
    numbers per vector, and the partial sums per task, 8 bytes a number; the edges, 24 bytes and the
    ids, are read where they were stored. The block is stored after every other product.

    No weights, no vectors. With fewer rows than columns, there are as many vectors as rows.
    Where eigenvalues are equal, as with several components, any basis of their space comes out.
    """
    edges, degrees = normalised(weights)
    rows = degrees.count()
    size, count = min(count + extra, rows), min(count, rows)
    if not rows:
        return Spectrum(degrees.select("id"), [], [], 0)
    # Hashes in -1..1; the first column is the trivial eigenvector of a connected graph.
    start = [(F.xxhash64("id", F.lit(c)) / float(1 << 63)).alias(f"y{c}") for c in range(1, size)]
    state = degrees.select("id", F.sqrt("degree").alias("y0"), *start)
    state = stored(state.join(_product(edges, state, "y", size), "id"), "block")
    values, residuals, done = np.zeros(size), np.ones(size), 0
    while done < rounds:
        done += 1
        if done > 1:
            state = stored(_filtered(edges, state, size, degree, float(values[-1])), "block")
        gram, ritz, square = _inner(state, [("y", "y"), ("y", "a"), ("a", "a")], size)
        power, basis = np.linalg.eigh(gram)
        keep = power > power[-1] * 1e-13
        white = basis[:, keep] / np.sqrt(power[keep])
        values, turn = np.linalg.eigh(white.T @ ((ritz + ritz.T) / 2) @ white)
        values, turn = values[::-1], (white @ turn)[:, ::-1]
        residuals = np.sqrt(np.maximum(np.diag(turn.T @ square @ turn) - values**2, 0.0))
        state = state.select("id", *_turned("y", turn, "y"), *_turned("a", turn, "a"))
        size = len(values)
        if (residuals[:count] <= tolerance).all():
            break
    count = min(count, size)
    vectors = stored(state.select("id", *[F.col(f"y{c}").alias(f"e{c}") for c in range(count)]), "eigenvectors")
    return Spectrum(vectors, values[:count].tolist(), residuals[:count].tolist(), done)


def _filtered(edges: DataFrame, state: DataFrame, size: int, degree: int, cut: float) -> DataFrame:
    """The block under the polynomial, and its product with the matrix, as y and a."""
    middle, half = (cut - 1) / 2, max((cut + 1) / 2, 1e-3)
    ys, ps = _names("y", size), _names("p", size)
    first = [((F.col(f"a{c}") - F.col(f"y{c}") * middle) / half).alias(f"y{c}") for c in range(size)]
    now = state.select("id", *first, *[F.col(y).alias(p) for y, p in zip(ys, ps)])
    for done in range(1, degree):
        # Spark plans long chains of joins at a cost that grows faster than their length.
        if done % PRODUCTS == 0:
            now = stored(now, "block")
        joined = now.join(_product(edges, now, "y", size), "id")
        step = [
            ((F.col(f"a{c}") - F.col(f"y{c}") * middle) * (2 / half) - F.col(f"p{c}")).alias(f"y{c}")
            for c in range(size)
        ]
        now = joined.select("id", *step, *[F.col(y).alias(p) for y, p in zip(ys, ps)])
    now = now.select("id", *ys)
    return now.join(_product(edges, now, "y", size), "id")


def spectral_layout(weights: DataFrame, dims: int = 2, **how) -> DataFrame:
    """``id`` and ``dim1``, ``dim2``, ...: the eigenvectors after the trivial one, with mean square 1.

    The sum of cubes of every dimension is not negative, which fixes its sign. ``how`` goes to
    ``eigenvectors``.
    """
    found = eigenvectors(weights, count=dims + 1, **how)
    names = [f"e{c}" for c in range(1, len(found.values))]
    cubes = [F.sum(F.pow(F.col(name), F.lit(3))).alias(name) for name in names]
    signs = found.vectors.agg(F.count(F.lit(1)).alias("n"), *cubes).first()
    factor = {name: math.copysign(math.sqrt(signs["n"]), signs[name] or 0.0) for name in names}
    own = [(F.col(name) * factor[name]).alias(f"dim{c}") for c, name in enumerate(names, 1)]
    empty = [F.lit(None).cast("double").alias(f"dim{c}") for c in range(len(names) + 1, dims + 1)]
    return found.vectors.select("id", *own, *empty)
