"""Embeddings out of the texts themselves: the leading singular vectors of their weighted words.

A randomised range finder: a block of hashed columns is multiplied by the sparse matrix of texts and
words and by its transpose in turn, made orthonormal in between, until it spans the leading singular
vectors. The matrix is stored in parts of whole texts, each with its own list of words. A task multiplies
a part by arrays; between tasks only the sums of words that stand in several parts are exchanged, one
row for each such word and part, however often its texts have it. The driver holds square matrices of
the block's width alone.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlens.functions.tokens import words_in
from reviewlens.schema import EMBEDDING_TYPE
from reviewlens.storage import stored

# Directions of a block that are weaker than this share of the strongest are rounding.
WEAKEST = 1e-12
# Pairs of text and word in a part of the matrix, but for the rest of the last slice of texts; and words of a slice,
# or pairs that are multiplied at a time, but for the rest of the last text.
PART_ENTRIES, SLICE_ENTRIES = 1 << 22, 1 << 19
# Words that Spark hands to a task at a time.
BATCH_BYTES, _BATCHES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
# Parts, and rows of the block for a part, in a file.
PARTS_A_FILE, BLOCKS_A_FILE = 1, 4

_MATRIX = "part long, sizes binary, low binary, high binary, counts binary, large binary"
_PARTS = f"{_MATRIX}, ids array<string>, words array<string>, spread array<int>"
_WEIGHTED = f"{_MATRIX}, rarity binary, length binary, shared binary, home binary, spot binary, y binary"


@dataclass
class Semantic:
    """``vectors`` has id and embedding; ``values`` are the singular values, falling."""

    vectors: DataFrame
    values: list[float]


def _bags(texts: DataFrame) -> DataFrame:
    """(id, words, counts): each id once, with the words of all its texts.

    ``counts`` is null where words come as often as the text has them. Only the words of ids that come
    more than once are shuffled; the different words of such an id end up in one row.
    """
    rows = texts.select(F.col("id").cast("string").alias("id"), words_in(texts, "text").alias("words"))
    rows = rows.where("id IS NOT NULL")
    repeated = stored(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
    none = F.array().cast("array<string>")
    uncounted = F.lit(None).cast("array<long>").alias("counts")
    if repeated.isEmpty():
        return rows.select("id", F.coalesce("words", none).alias("words"), uncounted)
    single = rows.join(repeated, "id", "left_anti").select("id", F.coalesce("words", none).alias("words"), uncounted)
    tokens = rows.join(repeated, "id", "left_semi").select("id", F.explode_outer("words").alias("word"))
    counted = tokens.groupBy("id", "word").agg(F.count("word").alias("n"))
    bag = F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "n"))).alias("bag")
    several = counted.groupBy("id").agg(bag)
    return single.unionByName(several.select("id", F.col("bag.word").alias("words"), F.col("bag.n").alias("counts")))


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile gets Arrow batches of ``BATCH_BYTES``, unless the session says otherwise."""
    own = _BATCHES not in spark.conf.getAll
    if own:
        spark.conf.set(_BATCHES, str(BATCH_BYTES))
    try:
        yield
    finally:
        if own:
            spark.conf.unset(_BATCHES)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part of the matrix: the texts' sizes, numbers of their words, and how often they come."""
    place, number, held, entries = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        for start, end in _cuts(batch.column(1).value_lengths().to_numpy(zero_copy_only=False)):
            held.append(_entries(batch.slice(start, end - start)))
            entries += len(held[-1][2])
            if entries >= PART_ENTRIES:
                yield _part(place + number, held)
                number, held, entries = number + 1, [], 0
    if held:
        yield _part(place + number, held)


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts with some ``SLICE_ENTRIES`` in all."""
    slices = (sizes.cumsum() - sizes) // SLICE_ENTRIES
    starts = np.flatnonzero(np.diff(slices, prepend=-1))
    yield from itertools.pairwise([*starts.tolist(), len(sizes)])


def _entries(batch: pa.RecordBatch) -> tuple:
    """ids, sizes, numbers of words by text, how often they come, and the batch's words."""
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    coded = batch.column(1).flatten().dictionary_encode()
    width = max(len(coded.dictionary), 1)
    keys = np.repeat(np.arange(len(sizes)), sizes) * width + coded.indices.to_numpy(zero_copy_only=False)
    given = batch.column(2)
    if given.null_count == len(given):
        keys, counts = np.unique(keys, return_counts=True)
    else:
        order = np.argsort(keys)
        amounts = np.ones(len(keys), np.int64)
        amounts[np.repeat(given.is_valid().to_numpy(zero_copy_only=False), sizes)] = given.flatten().to_numpy()
        keys, at = np.unique(keys[order], return_index=True)
        counts = np.add.reduceat(amounts[order], at) if len(at) else amounts
    # Eight bytes a pair until the part is full.
    kind = np.uint32 if counts.max(initial=0) < 1 << 32 else np.int64
    filled = np.bincount(keys // width, minlength=len(sizes))
    return batch.column(0), filled, (keys % width).astype(np.uint32), counts.astype(kind), coded.dictionary


def _binary(values: np.ndarray) -> pa.Array:
    """The bytes of numbers as the one row of a column, without a copy."""
    data = np.ascontiguousarray(values).view(np.uint8).ravel()
    ends = np.array([0, len(data)], np.int32)
    return pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _part(number: int, held: list[tuple]) -> pa.RecordBatch:
    ids, sizes, numbers, counts, words = (list(column) for column in zip(*held, strict=True))
    held.clear()
    coded = pa.concat_arrays(words).dictionary_encode()
    own, at, total = coded.indices.to_numpy(zero_copy_only=False), 0, sum(map(len, numbers))
    spread, mapped = np.zeros(len(coded.dictionary), np.int64), []
    for some, names in zip(numbers, words, strict=True):
        mapped.append(own[at : at + len(names)])
        spread += np.bincount(mapped[-1][some], minlength=len(spread))
        at += len(names)
    # Common words get small numbers, whose upper halves are mostly nought and so take no room.
    order = np.argsort(-spread, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order))
    low, high, few, large, at = np.empty(total, np.uint16), np.empty(total, np.uint16), np.empty(total, np.uint8), [], 0
    for n, names in enumerate(mapped):
        codes, end, many = place[names[numbers[n]]], at + len(numbers[n]), counts[n] > 255
        low[at:end], high[at:end], few[at:end] = codes & 0xFFFF, codes >> 16, np.where(many, 0, counts[n])
        large.append(counts[n][many].astype(np.int64))
        numbers[n] = counts[n] = None
        at = end
    row = {"sizes": np.concatenate(sizes).astype(np.int64), "low": low, "high": high, "counts": few}
    columns = [pa.array([number], pa.int64()), *map(_binary, row.values()), _binary(np.concatenate(large))]
    lists = [pa.concat_arrays(ids), coded.dictionary.take(pa.array(order)), pa.array(spread[order], pa.int32())]
    columns += [pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values) for values in lists]
    return pa.RecordBatch.from_arrays(columns, names=["part", *row, "large", "ids", "words", "spread"])


def _vocabulary(parts: DataFrame, total: int, width: int) -> DataFrame:
    """(part, place, rarity, home, spot, y): the words of the parts; those of one part have no home.

    The home of a word is the first of the parts that have it, and its place there. ``y`` are hashes
    in -1..1, the same for a word wherever it stands.
    """
    listed = F.posexplode(F.arrays_zip("words", "spread")).alias("place", "word")
    each = parts.select("part", listed).select("part", "place", F.col("word.words").alias("word"), "word.spread")
    same = Window.partitionBy("word")
    rarity = F.lit(1.0) + F.log(F.lit(1.0 + total) / (F.lit(1.0) + F.sum("spread").over(same)))
    home = F.when(F.count(F.lit(1)).over(same) > 1, F.min(F.struct("part", "place")).over(same))
    start = F.array(*[F.xxhash64("word", F.lit(c)) / float(1 << 63) for c in range(width)])
    found = each.select("part", "place", "word", rarity.alias("rarity"), home.alias("home"))
    return found.select(
        "part", "place", "rarity", F.col("home.part").alias("home"), F.col("home.place").alias("spot"), start.alias("y")
    )


def _cell(table: pa.Table, name: str, kind: type) -> np.ndarray:
    """The numbers in a table's one row."""
    return np.frombuffer(table[name][0].as_buffer(), kind)


class _Part:
    """A part of the matrix, multiplied by runs of its texts."""

    def __init__(self, row: pa.Table, rarity: np.ndarray, length: np.ndarray | None = None) -> None:
        self.sizes, self.rarity = _cell(row, "sizes", np.int64), rarity
        self.low, self.high = _cell(row, "low", np.uint16), _cell(row, "high", np.uint16)
        self.counts, self.large = _cell(row, "counts", np.uint8), _cell(row, "large", np.int64)
        self.length = length
        if length is None:
            squares = [self._by_text(values * values, own) for _, own, _, values in self._runs()]
            self.length = np.sqrt(np.concatenate([np.zeros(0), *squares]))

    def _runs(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """For runs of texts: which, their sizes, and the numbers of their words with the values."""
        at = large = 0
        for start, end in _cuts(self.sizes):
            own = self.sizes[start:end]
            until = at + int(own.sum())
            codes = self.high[at:until].astype(np.int64) << 16 | self.low[at:until]
            values = self.counts[at:until].astype(np.float64)
            many = np.flatnonzero(values == 0)
            values[many] = self.large[large : large + len(many)]
            values *= self.rarity[codes]
            if self.length is not None:
                values /= np.repeat(self.length[start:end], own)
            yield slice(start, end), own, codes, values
            at, large = until, large + len(many)

    def _by_text(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sums, filled = np.zeros(len(sizes)), sizes > 0
        if len(values):
            sums[filled] = np.add.reduceat(values, (sizes.cumsum() - sizes)[filled])
        return sums

    def times(self, z: np.ndarray) -> np.ndarray:
        """The part times numbers for each of its words, a row of them by column."""
        product = np.zeros((len(self.sizes), len(z)))
        for texts, own, codes, values in self._runs():
            for n, column in enumerate(z):
                product[texts, n] = self._by_text(values * column[codes], own)
        return product

    def transposed(self, q: np.ndarray) -> np.ndarray:
        """The part's transpose times a row of numbers for each of its texts: a row for each column of these."""
        sums = np.zeros((q.shape[1], len(self.rarity)))
        for texts, own, codes, values in self._runs():
            for n, column in enumerate(q[texts].T):
                sums[n] += np.bincount(codes, values * np.repeat(column, own), len(self.rarity))
        return sums


def _scattered(table: pa.Table, name: str, into: np.ndarray) -> None:
    """Puts the lists of a column into the columns of ``into`` that ``place`` names, batch by batch."""
    for batch in table.select(["place", name]).to_batches():
        own = batch.filter(batch.column(1).is_valid())
        if len(own):
            into[:, own.column(0).to_numpy()] = own.column(1).flatten().to_numpy().reshape(len(own), -1).T


def _weighted(parts: DataFrame, vocabulary: DataFrame, width: int) -> DataFrame:
    """The parts with the rarities of their words, the lengths of their texts, and their first product."""

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["place"].to_numpy())
        rarity = right["rarity"].to_numpy()[order]
        start = np.empty((width, len(order)))
        _scattered(right, "y", start)
        shared = np.flatnonzero(right["home"].is_valid().to_numpy()[order])
        part = _Part(left, rarity)
        kept = {
            "rarity": rarity,
            "length": part.length,
            "shared": shared.astype(np.int32),
            "home": right["home"].combine_chunks().fill_null(0).to_numpy()[order][shared],
            "spot": right["spot"].combine_chunks().fill_null(0).to_numpy()[order][shared],
            "y": part.times(start),
        }
        for name, values in kept.items():
            left = left.append_column(name, _binary(values))
        return left

    names = [field.split()[0] for field in _MATRIX.split(", ")]
    own = parts.select(*names).groupBy("part")
    # A part without words has no vocabulary, and its texts rows of zeros.
    return own.cogroup(vocabulary.groupBy("part")).applyInArrow(
        lambda left, right: weigh(left, right) if right.num_rows else _unweighted(left, width), _WEIGHTED
    )


def _unweighted(left: pa.Table, width: int) -> pa.Table:
    texts = len(_cell(left, "sizes", np.int64))
    for name in ("rarity", "length", "shared", "home", "spot", "y"):
        zeros = {"length": texts, "y": texts * width}.get(name, 0)
        left = left.append_column(name, pa.array([bytes(8 * zeros)], pa.binary()))
    return left


def _block(table: pa.Table | pa.RecordBatch, turn: np.ndarray) -> np.ndarray:
    """A part's rows of the block, its columns combined by a small matrix."""
    return _cell(table, "y", np.float64).reshape(-1, len(turn)) @ turn


def _shared_sums(matrix: DataFrame, state: DataFrame, turn: np.ndarray) -> DataFrame:
    """(part, place, z): the transpose's product for the words of several parts, as each part has them."""
    width = turn.shape[1]
    names = [f"y{c}" for c in range(width)]

    def partial(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Part(left, _cell(left, "rarity", np.float64), _cell(left, "length", np.float64))
        place = _cell(left, "shared", np.int32)
        sums = part.transposed(_block(right, turn))
        keys = [_cell(left, "home", np.int64), _cell(left, "spot", np.int32), np.repeat(left["part"].to_numpy(), len(place))]
        return pa.table([*keys, place, *(own[place] for own in sums)], names=["home", "spot", "part", "place", *names])

    schema = "home long, spot int, part long, place int, " + ", ".join(f"{name} double" for name in names)
    sums = matrix.groupBy("part").cogroup(state.groupBy("part")).applyInArrow(partial, schema)
    same = Window.partitionBy("home", "spot")
    return sums.select("part", "place", F.array(*[F.sum(name).over(same) for name in names]).alias("z"))


def _product(matrix: DataFrame, state: DataFrame, turn: np.ndarray) -> DataFrame:
    """(part, y, inner): the matrix times its transpose times the turned block, and the block's inner
    products with that: those of the transpose's product with itself."""
    width = turn.shape[1]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        part = _Part(left, _cell(left, "rarity", np.float64), _cell(left, "length", np.float64))
        own = right["y"].is_valid()
        block = _block(right.filter(own), turn)
        sums = part.transposed(block)
        _scattered(right, "z", sums)
        product = part.times(sums)
        inner = pa.array([(block.T @ product).ravel()], pa.list_(pa.float64()))
        return pa.table([left["part"], _binary(product), inner], names=["part", "y", "inner"])

    sums = _shared_sums(matrix, state, turn).withColumn("y", F.lit(None).cast("binary"))
    own = state.select("part", F.lit(-1).alias("place"), F.lit(None).cast("array<double>").alias("z"), "y")
    joined = matrix.groupBy("part").cogroup(sums.unionByName(own).groupBy("part"))
    return stored(joined.applyInArrow(finish, "part long, y binary, inner array<double>"), "block", BLOCKS_A_FILE)


def _total(state: DataFrame, size: int, numbers: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """``numbers`` of the parts' rows of the block, added up by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for n in range(len(batch)):
                total += numbers(batch.slice(n, 1)).ravel()
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(size), pa.int32()), "value": total})

    sums = state.mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value"))
    flat = np.zeros(size)
    for place, value in sums.collect():
        flat[place] = value
    return flat


def _gram(state: DataFrame, turn: np.ndarray) -> np.ndarray:
    """The inner products of the turned block's columns."""

    def inner(row: pa.RecordBatch) -> np.ndarray:
        block = _block(row, turn)
        return block.T @ block

    width = turn.shape[1]
    return _total(state.select("y"), width * width, inner).reshape(width, width)


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What turns a block of these inner products into an orthonormal basis of its columns."""
    power, basis = np.linalg.eigh((gram + gram.T) / 2)
    keep = power > max(power[-1], 0.0) * WEAKEST
    return basis[:, keep] / np.sqrt(power[keep])


def _inner(product: DataFrame, width: int) -> np.ndarray:
    found = _total(product.select("inner"), width * width, lambda row: row.column(0).flatten().to_numpy())
    return found.reshape(width, width)


def semantic_embeddings(texts: DataFrame, dims: int = 16, extra: int = 8, rounds: int = 4) -> Semantic:
    """``id`` and an ``embedding`` of ``dims`` numbers for each id of ``texts`` (id, text).

    An entry of the matrix is how often a text has a word, times the word's rarity, at length one per
    text. The rarity of a word is 1 + ln((1 + n) / (1 + d)) with d of the n ids with words having it; texts
    of one id count as one text.

    The embedding is the text's row of the matrix in the directions of its ``dims`` leading right
    singular vectors. ``extra`` columns and ``rounds`` products with the matrix and its transpose sharpen
    these: an error shrinks with every round by the square of the ratio of the first value left out
    of the block to the one in question. Each of the ``rounds`` + 1 products with both sends the stored
    matrix, 3 to 5 bytes for each text's word, twice, and ``dims + extra`` numbers for each word that several
    parts have and each such part, there and back.

    The sum of cubes of every dimension is not negative, which fixes its sign; where singular values are
    equal, any basis of their space comes out. Null, empty and wordless texts have a vector of zeros, and
    so have dimensions beyond the rank. A null id is left out; no texts, no rows.
    """
    width, values = dims + extra, np.zeros(0)
    # Fewer parts have fewer words in common; splits of the input may be small.
    tasks = 2 * texts.sparkSession.sparkContext.defaultParallelism
    with _small_batches(texts.sparkSession):
        parts = stored(_bags(texts).coalesce(tasks).mapInArrow(_parts, _PARTS), "parts", PARTS_A_FILE)
    worded = _total(parts.select("sizes"), 1, lambda row: np.array([(_cell(row, "sizes", np.int64) > 0).sum()], float))
    matrix = stored(_weighted(parts, _vocabulary(parts, int(worded[0]), width), width), "matrix", PARTS_A_FILE)
    state, matrix = matrix.select("part", "y"), matrix.drop("y")
    turn = np.eye(width)
    for _ in range(rounds):
        turn = turn @ _orthonormal(_gram(state, turn))
        if not turn.shape[1]:
            break
        state = _product(matrix, state, turn)
        turn = _orthonormal(_inner(state, turn.shape[1]))
    if turn.shape[1]:
        turn = turn @ _orthonormal(_gram(state, turn))
    if turn.shape[1]:
        state = _product(matrix, state, turn)
        squares, basis = np.linalg.eigh(_inner(state, turn.shape[1]))
        values = np.sqrt(np.maximum(squares[::-1], 0.0))[:dims]
        # The matrix times the right singular vectors; what is nothing but rounding has none.
        known = values > WEAKEST**0.5 * values.max(initial=0.0)
        turn = basis[:, ::-1][:, :dims] * np.divide(1.0, values, out=np.zeros(len(values)), where=known)
        cubes = _total(state.select("y"), len(values), lambda row: (_block(row, turn) ** 3).sum(axis=0))
        turn = turn * np.where(cubes < 0, -1.0, 1.0)

    def place(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left["ids"].combine_chunks().flatten()
        rows = np.zeros((len(ids), dims), np.float32)
        rows[:, : turn.shape[1]] = _block(right, turn)
        ends = pa.array(np.arange(len(ids) + 1) * dims, pa.int32())
        return pa.table([ids, pa.ListArray.from_arrays(ends, pa.array(rows.ravel()))], names=["id", "embedding"])

    joined = parts.select("part", "ids").groupBy("part").cogroup(state.select("part", "y").groupBy("part"))
    return Semantic(joined.applyInArrow(place, f"id string, embedding {EMBEDDING_TYPE.simpleString()}"), values.tolist())
