"""Exact cosine nearest neighbours of every embedding.

At length one, cosine order is distance order, so the triangle inequality prunes. Vectors are
assigned to the nearest of about sqrt(n) sampled pivots, so cells grow as slowly as their number.
Each vector first meets a block of its own cell and then the cells whose pivots are nearest, which
bounds how far its neighbours can be; in the last round it visits only the other cells that reach
within that bound. Cells near each other make up a region of some ``SIDE_BYTES`` of vectors. A task holds
a region and as many bytes of visiting vectors, each with the cells that it visits there, and keeps the
best k of each; pairs are never written out, and a vector travels once to a region, not to each of its
cells. Equal vectors are treated as one, so any number of copies costs no more than a single vector.

How much is pruned depends on the data. Well separated groups visit few cells. Vectors without
structure visit nearly all of them, as any exact method must: the work is then quadratic, and so are,
in 65,536ths for vectors of 64 numbers, the rows moved.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.operators.embeddings import l2_normalize
from reviewlens.storage import cut_lineage

# Slack for rounding when distances are compared; visiting too much is harmless.
SLACK = 1e-6
# Pivots that the driver and every task hold at most; beyond, cells grow and not their number.
MOST_PIVOTS = 8192
# Distances to pivots that a task works out at a time.
DISTANCES = 4_000_000
# Vectors of each side that a task holds at most.
SIDE_BYTES = 32 << 20

_HIT = "vec string, sim double, ids array<string>"


def knn_graph(
    df: DataFrame, k: int = 15, block_rows: int = 1024, visitor_rows: int = 4096, nearest: int = 4
) -> DataFrame:
    """``id``, ``rank`` 1..k, ``neighbour`` and ``sim``; ties in similarity go by neighbour id.

    A row is not its own neighbour. Zero vectors have no neighbours and are none. ``nearest`` cells
    are visited before the bound is set. Cells are cut into blocks of some ``block_rows``, of which regions are
    made; ``visitor_rows`` vectors and ``block_rows`` are compared at a time.
    """
    points = l2_normalize(df.select(F.col("id").cast("string").alias("id"), "embedding"))
    points = points.where(F.col("embedding").isNotNull())
    vectors = cut_lineage(_distinct_vectors(points, k))
    pivots = _pivots(vectors)
    placed = cut_lineage(_into_cells(vectors, pivots, block_rows))
    radius, sizes, blocks = np.zeros(len(pivots)), *np.zeros((2, len(pivots)), np.int64)
    measures = F.max("away").alias("r"), F.count(F.lit(1)).alias("n"), F.first("parts").alias("parts")
    for row in placed.groupBy("cell").agg(*measures).collect():
        radius[row["cell"]], sizes[row["cell"]], blocks[row["cell"]] = row["r"], row["n"], row["parts"]
    # Some four tasks for each that runs at a time; more only where the vectors take more room.
    sides = math.ceil(math.sqrt(4 * df.sparkSession.sparkContext.defaultParallelism))
    fitting = SIDE_BYTES // (8 * max(pivots.shape[-1], 1))
    rows = max(1, min(fitting, math.ceil(sizes.sum() / sides)))
    regions = _regions(pivots, sizes, blocks, rows)

    first = cut_lineage(_met(placed, placed, pivots, None, nearest, regions, k, rows, visitor_rows, block_rows))
    # The k-th best so far bounds the rest; with fewer than k, anything may still be a neighbour.
    order = Window.partitionBy("vec").orderBy(F.desc("sim"))
    copies = F.sum(F.size("ids")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    bound = first.withColumn("copies", copies).where(F.col("copies") > k).groupBy("vec").agg(
        F.max("sim").alias("least")
    )
    bounded = placed.join(bound, "vec", "left")
    met = _met(placed, bounded, pivots, radius, nearest, regions, k, rows, visitor_rows, block_rows)
    return _neighbours(points, vectors, first.unionByName(met), k)


def _pivots(vectors: DataFrame) -> np.ndarray:
    """About sqrt(n) of the vectors, ``MOST_PIVOTS`` at most, by the hash of their ids."""
    wanted = min(math.isqrt(vectors.count()) + 1, MOST_PIVOTS)
    sample = vectors.orderBy(F.xxhash64("vec"), "vec").select("embedding").limit(wanted)
    return np.array([row["embedding"] for row in sample.collect()])


def _into_cells(vectors: DataFrame, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """Vectors with their cell, their distance to its pivot, and a block of the cell."""
    schema = "vec string, ids array<string>, embedding array<double>, cell int, away double"

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch, len(pivots)):
                away = _distances(_matrix(part["embedding"]) @ pivots.T)
                cell = away.argmin(axis=1)
                yield part.assign(cell=cell, away=away[np.arange(len(cell)), cell])

    placed = vectors.select("vec", "ids", "embedding").mapInPandas(place, schema)
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("parts"))
    return placed.join(sizes, "cell").withColumn(
        "block", F.pmod(F.xxhash64("vec"), F.col("parts")).cast("int")
    )


@dataclass
class _Regions:
    """``cells``: for each region the cells of which it has blocks. Blocks are numbered through the regions:
    ``first`` is the number of a cell's first block, ``begin`` that of a region."""

    cells: list[np.ndarray]
    first: np.ndarray
    begin: np.ndarray


def _near_each_other(pivots: np.ndarray) -> np.ndarray:
    """Numbers of the pivots, those near each other one behind another as far as halving them gives it."""
    todo, out = [np.arange(len(pivots))], []
    while todo:
        own = todo.pop()
        if len(own) < 3:
            out.append(own)
            continue
        # Along the line between two that are far apart.
        one = own[(pivots[own] @ pivots[own[0]]).argmin()]
        other = own[(pivots[own] @ pivots[one]).argmin()]
        own = own[np.argsort(pivots[own] @ (pivots[one] - pivots[other]), kind="stable")]
        todo += [own[len(own) // 2 :], own[: len(own) // 2]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _regions(pivots: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, rows: int) -> _Regions:
    """Regions of about ``rows`` vectors, by the cells' sizes and numbers of blocks."""
    order = _near_each_other(pivots)
    first = np.zeros(len(order), np.int64)
    first[order] = np.cumsum(blocks[order]) - blocks[order]
    cell = np.repeat(order, blocks[order])
    held = np.cumsum(sizes[cell] / blocks[cell])
    region = np.minimum(np.ceil(held / rows), math.ceil(held[-1] / rows)).astype(np.int64) if len(cell) else cell
    begin = np.flatnonzero(np.diff(region, prepend=-1))
    cells = [np.unique(own) for own in np.split(cell, begin[1:])] if len(cell) else []
    return _Regions(cells, first, begin)


def _wanted(part: pd.DataFrame, pivots: np.ndarray, radius: np.ndarray | None, nearest: int) -> np.ndarray:
    """For each row the cells: the nearest, or with ``radius`` all others that may hold a neighbour."""
    away = _distances(_matrix(part["embedding"]) @ pivots.T)
    count = min(nearest, len(pivots))
    wanted = np.zeros(away.shape, dtype=bool)
    np.put_along_axis(wanted, np.argpartition(away, count - 1, axis=1)[:, :count], True, axis=1)
    if radius is None:
        return wanted
    bound = _distances(part["least"].fillna(-1.0).to_numpy())
    return ~wanted & (away - radius <= bound[:, None] + SLACK)


def _cells_to_visit(
    placed: DataFrame, pivots: np.ndarray, radius: np.ndarray | None, nearest: int
) -> DataFrame:
    """(vec, cell): the nearest cells, or with ``radius`` all others that may hold a neighbour."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _slices(batch, len(pivots)):
                row, cell = np.nonzero(_wanted(part, pivots, radius, nearest))
                yield pd.DataFrame({"vec": part["vec"].to_numpy()[row], "cell": cell})

    columns = ["vec", "embedding"] + (["least"] if radius is not None else [])
    return placed.select(*columns).mapInPandas(visit, "vec string, cell int")


def _met(
    placed: DataFrame, bounded: DataFrame, pivots: np.ndarray, radius: np.ndarray | None, nearest: int,
    regions: _Regions, k: int, rows: int, visitor_rows: int, block_rows: int,
) -> DataFrame:
    """The best k + 1 that each vector finds in each region with cells it visits, but none below its bound."""

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame, np.ndarray]]:
        """(region, its visitors, their cells there)"""
        for batch in batches:
            for part in _slices(batch, len(pivots)):
                wanted = _wanted(part, pivots, radius, nearest)
                for region, cells in enumerate(regions.cells):
                    own = wanted[:, cells]
                    some = np.flatnonzero(own.any(axis=1))
                    if len(some):
                        yield region, part.iloc[some], own[some]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for region, part, _ in visits(batches):
            yield pd.DataFrame({"region": [region], "n": [len(part)]})

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for region, part, own in visits(batches):
            cells = [row.tobytes() for row in np.packbits(own, axis=1)]
            yield part.assign(region=region, cells=cells)

    def host(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            number = regions.first[part["cell"]] + part["block"].to_numpy()
            yield part.assign(region=np.searchsorted(regions.begin, number, "right") - 1).drop(columns="block")

    if radius is None:
        bounded = bounded.withColumn("least", F.lit(None).cast("double"))
    columns = bounded.select("vec", "embedding", "least")
    tasks = np.zeros(len(regions.cells), np.int64)
    for row in columns.mapInPandas(count, "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).collect():
        tasks[row["region"]] = math.ceil(row["n"] / rows)
    # Of a region without visitors: none.
    listed = F.array(*map(F.lit, tasks.tolist())).cast("array<int>") if len(tasks) else F.array().cast("array<int>")
    called = columns.mapInPandas(call, "vec string, embedding array<double>, least double, region int, cells binary")
    hosted = placed.select("vec", "ids", "embedding", "cell", "block").mapInPandas(
        host, "vec string, ids array<string>, embedding array<double>, cell int, region int"
    )
    visitors = called.withColumn("task", F.pmod(F.xxhash64("vec"), F.get(listed, F.col("region"))).cast("int"))
    needed = F.when(F.get(listed, F.col("region")) > 0, F.sequence(F.lit(0), F.get(listed, F.col("region")) - 1))
    hosts = hosted.withColumn("task", F.explode(needed))
    key = ["region", "task"]
    search = _across(k, regions, pivots, radius, visitor_rows, block_rows)
    return visitors.groupBy(*key).cogroup(hosts.groupBy(*key)).applyInArrow(search, _HIT)


def _slices(batch: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """Rows of a batch, as many at a time as their distances to ``width`` pivots allow."""
    step = max(1, DISTANCES // max(width, 1))
    for at in range(0, len(batch), step):
        yield batch.iloc[at : at + step]


def _distinct_vectors(points: DataFrame, k: int) -> DataFrame:
    """Each vector once, with the first k + 1 ids that have it; no neighbour list needs more.

    The row-number limit is applied before the shuffle too, so the copies of a vector never meet.
    """
    copies = Window.partitionBy("embedding").orderBy("id")
    few = points.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1)
    grouped = few.groupBy("embedding").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return grouped.select(F.col("ids")[0].alias("vec"), "ids", "embedding")


def _neighbours(points: DataFrame, vectors: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The best k of everything found for a vector, given to every id that has the vector."""
    each = hits.select("vec", "sim", F.explode("ids").alias("neighbour"))
    order = Window.partitionBy("vec").orderBy(F.desc("sim"), F.asc("neighbour"))
    # One more than k, since one of them may be the id itself.
    best = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    hit = F.struct("place", "sim", "neighbour")
    lists = best.groupBy("vec").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    by_vector = vectors.select("vec", "embedding").join(lists, "vec").drop("vec")
    given = points.join(cut_lineage(by_vector), "embedding")
    others = F.filter("hits", lambda hit: hit["neighbour"] != F.col("id"))
    ranked = given.select("id", F.posexplode(F.slice(others, 1, k)).alias("pos", "hit"))
    return ranked.select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("hit.neighbour").alias("neighbour"), "hit.sim"
    )


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(np.float64)


def _distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


def _stacked(column: pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    flat = [chunk.flatten().to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(flat).reshape(len(column), -1)


class _Best:
    """The ``k`` best (similarity, host) of each visitor so far; of equal ones the first in ``rank``."""

    def __init__(self, visitors: int, k: int, rank: np.ndarray):
        self.sims = np.full((visitors, k), -np.inf)
        self.hosts = np.full((visitors, k), -1)
        self.rank = rank

    def add(self, row: np.ndarray, host: np.ndarray, sim: np.ndarray) -> np.ndarray:
        """Takes in what is found; the rows come in order. Gives the visitors that found something."""
        k = self.sims.shape[1]
        own = row[np.flatnonzero(np.diff(row, prepend=-1))]
        row = np.concatenate([np.repeat(own, k), row])
        host = np.concatenate([self.hosts[own].ravel(), host])
        sim = np.concatenate([self.sims[own].ravel(), sim])
        order = np.lexsort((self.rank[host], -sim, row))
        begin = np.flatnonzero(np.diff(row[order], prepend=-1))
        kept = order[begin[:, None] + np.arange(k)]
        self.sims[own], self.hosts[own] = sim[kept], host[kept]
        return own


def _across(
    k: int, regions: _Regions, pivots: np.ndarray, radius: np.ndarray | None, visitor_rows: int, block_rows: int
) -> Callable:
    """Compares visitors with the hosts of a region, by the cells that they visit.

    Similarities are worked out in single precision, and again in double precision for what these do not
    rule out. What has been found tells which of a visitor's other cells may still hold more.
    """

    def search(key: tuple, visitors: pa.Table, hosts: pa.Table) -> pa.Table:
        schema = pa.schema({"vec": pa.string(), "sim": pa.float64(), "ids": pa.list_(pa.string())})
        if not visitors.num_rows or not hosts.num_rows:
            return schema.empty_table()
        cells = regions.cells[key[0].as_py()]
        hosts = hosts.take(pc.sort_indices(hosts, [("cell", "ascending"), ("vec", "ascending")]))
        rank = np.empty(hosts.num_rows, np.int64)
        rank[pc.sort_indices(hosts["vec"]).to_numpy()] = np.arange(hosts.num_rows)
        ends = np.searchsorted(hosts["cell"].to_numpy(), np.append(cells, len(pivots)))
        guests, theirs = _stacked(visitors["embedding"]), _stacked(hosts["embedding"])
        few, their_few = guests.astype(np.float32), theirs.astype(np.float32)
        error = (guests.shape[1] + 8) * 2.0**-23
        packed = np.frombuffer(b"".join(visitors["cells"].to_pylist()), np.uint8).reshape(len(guests), -1)
        wanted = np.unpackbits(packed, axis=1, count=len(cells)).astype(bool)
        least = visitors["least"].to_numpy().astype(float)
        least = np.where(np.isnan(least), -np.inf, least - 1e-12)
        floor = least.copy()
        best = _Best(len(guests), k + 1, rank)

        def compare(some: np.ndarray, start: int, end: int) -> None:
            sims = few[some] @ their_few[start:end].T
            low = floor[some] - error
            if end - start > k and (low < -1).any():
                low = np.maximum(low, np.partition(sims, -k - 1, axis=1)[:, -k - 1] - 2 * error)
            row, host = np.nonzero(sims >= low.astype(np.float32)[:, None])
            if len(row):
                row, host = some[row], host + start
                sim = np.concatenate(
                    [
                        np.einsum("ij,ij->i", guests[row[at : at + visitor_rows]], theirs[host[at : at + visitor_rows]])
                        for at in range(0, len(row), visitor_rows)
                    ]
                )
                own = best.add(row, host, sim)
                floor[own] = np.maximum(floor[own], best.sims[own, -1])

        for n, cell in enumerate(cells):
            some = np.flatnonzero(wanted[:, n])
            for at in range(0, len(some), visitor_rows):
                own = some[at : at + visitor_rows]
                if radius is not None:
                    away = _distances(guests[own] @ pivots[cell])
                    own = own[away - radius[cell] <= _distances(np.maximum(floor[own], -1.0)) + SLACK]
                for start in range(ends[n], ends[n + 1], block_rows):
                    if len(own):
                        compare(own, start, min(start + block_rows, ends[n + 1]))
        row, place = np.nonzero((best.hosts >= 0) & (best.sims >= least[:, None]))
        found = pa.array(best.hosts[row, place])
        columns = [visitors["vec"].take(pa.array(row)), pa.array(best.sims[row, place]), hosts["ids"].take(found)]
        return pa.table(columns, schema=schema)

    return search
