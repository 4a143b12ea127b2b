"""CSV files with quoted line breaks, read by as many tasks as they have splits.

A split may begin inside a quoted field, and nothing in it says so. What a line does to the state,
outside or inside quotes, can be told for both cases without knowing which holds; so a first pass
finds, for every split, where it ends if it begins outside and if it begins inside. A running
composition over a file's splits, one row each, then gives the state in which each begins. The
second pass puts the lines of each split together to records. Only what is cut by a border between
splits is shuffled: at most two fragments of records for each split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from reviewlens.storage import cut_lineage

# A quoted field's content, up to its closing quote; the quantifiers never give anything back.
_INSIDE = r'(?:[^"]++|"")*+'
# From the start of a field on: whole fields, then one that is opened and not closed.
_OPENED = rf'(?:(?:"{_INSIDE}"[^,]*+|(?!")[^,]*+),)*+"{_INSIDE}\Z'
OPENS = re.compile(rf"﻿?{_OPENED}")
STAYS_OPEN = re.compile(rf'{_INSIDE}(?:\Z|"[^,]*+,{_OPENED})')

_SPLIT = "file string, block long, from_outside boolean, from_inside boolean"
_RECORD = "file string, block long, kind int, open boolean, header boolean, record string"
# Kinds of what a split yields: whole records, what continues a record, a record cut at the end.
WHOLE, CONTINUED, CUT = 0, 1, 2


def is_inside(line: str, inside: bool) -> bool:
    """Whether a line ends within quotes, when it begins within quotes or as a record."""
    return (STAYS_OPEN if inside else OPENS).match(line) is not None


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as they lie in the files, split at \\n alone, with their file and split."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """The lines of one split after the other; a split's lines may go on in the next batch."""
    block = batch.column(1).to_numpy()
    # Blocks of two files may have one number, so files are told apart by their names, encoded.
    file = batch.column(0).dictionary_encode()
    code = file.indices.to_numpy()
    edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
    for a, b in zip([0, *edges], [*edges, batch.num_rows]):
        if b > a:
            yield file.dictionary[int(code[a])].as_py(), int(block[a]), batch.column(2).slice(a, b - a)


def split_ends(lines: DataFrame) -> DataFrame:
    """For each split with lines, the state at its end from either state at its start."""

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends, done = None, [False, True], []
        for batch in batches:
            for file, block, values in _runs(batch):
                if key != (file, block):
                    if key is not None:
                        done.append((*key, *ends))
                    key, ends = (file, block), [False, True]
                # Lines without a quote leave both states as they are.
                quoted = pc.indices_nonzero(pc.match_substring(values, '"'))
                for line in values.take(quoted).to_pylist():
                    if ends[0] == ends[1]:
                        ends = [is_inside(line, ends[0])] * 2
                    else:
                        ends = [is_inside(line, state) for state in ends]
        if key is not None:
            done.append((*key, *ends))
        names = [field.split()[0] for field in _SPLIT.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
        columns = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=names
        )

    return lines.mapInArrow(follow, _SPLIT)


def split_starts(ends: DataFrame) -> DataFrame:
    """file, block and whether a split begins within quotes, by composing those before it.

    A split either sets the state, whatever it was, or keeps it, or turns it round. So the state
    is the one last set, turned round as often as splits since then did that: a running count of
    the turns, and the last value set, taken back by the turns up to there.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("from_outside") == F.col("from_inside")
    turns = (~sets & F.col("from_outside")).cast("int")
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    counted = ends.withColumn("turned", F.sum(turns).over(upto))
    fixed = F.when(sets, F.col("from_outside").cast("int") + F.col("turned"))
    # A file begins outside, with no turns.
    base = F.coalesce(F.last(fixed, ignorenulls=True).over(before), F.lit(0))
    turned = F.coalesce(F.last("turned").over(before), F.lit(0))
    inside = F.pmod(base + turned, F.lit(2)) == 1
    return counted.select("file", "block", inside.alias("inside"))


def split_records(lines: DataFrame, splits: np.ndarray, inside: np.ndarray) -> DataFrame:
    """Records of each split, and the fragments at its borders, in the order of the lines.

    ``splits``: sorted hashes of all splits; ``inside``: whether each begins within quotes. A split
    that is not among them was cut otherwise by the first pass, and is an error.
    """
    marked = lines.withColumn("key", F.xxhash64("file", "block"))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind, parts, header = None, False, WHOLE, [], False
        out: list[tuple] = []

        def close(is_open: bool) -> None:
            nonlocal parts, kind, header
            if parts:
                text = "\n".join(parts)
                if not is_open:
                    text = text.removesuffix("\r")
                whole = kind == WHOLE
                if text or not whole:
                    first = whole and header
                    out.append((*key, CUT if whole and is_open else kind, is_open, first, text))
                    header = header and not whole
            parts, kind = [], WHOLE

        for batch in batches:
            hashes = batch.column(3)
            at = 0
            for file, block, values in _runs(batch):
                if key != (file, block):
                    close(state)
                    key = (file, block)
                    mark = hashes[at].as_py()
                    found = int(np.searchsorted(splits, mark))
                    if found == len(splits) or splits[found] != mark:
                        raise RuntimeError(f"{file} was split otherwise between the two passes")
                    state = bool(inside[found])
                    kind, header = (CONTINUED if state else WHOLE), block == 0
                at += len(values)
                quoted = pc.match_substring(values, '"').to_pylist()
                for line, quote in zip(values.to_pylist(), quoted):
                    parts.append(line)
                    if quote:
                        state = is_inside(line, state)
                    if not state:
                        close(False)
            yield _records(out)
            out = []
        close(state)
        yield _records(out)

    def _records(rows: list[tuple]) -> pa.RecordBatch:
        names = [field.split()[0] for field in _RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.string()]
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], names=names
        )

    return marked.mapInArrow(put_together, _RECORD)


def stitched(fragments: DataFrame) -> DataFrame:
    """Records that lie in several splits, from their fragments: header, record.

    The order of a file's fragments is found from their places alone, without the texts.
    """
    places = fragments.select("file", "block", "kind")
    order = Window.partitionBy("file").orderBy("block", "kind")
    run = F.sum((F.col("kind") == CUT).cast("long")).over(order)
    numbered = places.withColumn("run", run)
    texts = fragments.join(numbered, ["file", "block", "kind"])
    part = F.struct("block", "record")
    return texts.groupBy("file", "run").agg(
        F.max("header").alias("header"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(part)), lambda p: p["record"]), "\n"
        ).alias("record"),
    )


def read_quoted_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, quoted by RFC 4180, all columns strings, as Spark's multi-line reader
    gives it, but read in splits.

    Quotes that do not begin a field are plain characters. Records end with \\n or \\r\\n; within
    quotes both stay as they are (Spark's reader shortens \\r\\n there if records end so, too); empty
    lines are no records. Every file's first record is its
    header, and the first file's gives the names. A quote that is never closed runs to the end of
    its file. The driver and the tasks hold 9 bytes for each split. The two passes must see the same
    splits: should the number of cores change in between, the second says so and fails.
    """
    options = {"header": "true", "multiLine": "true", "escape": '"', "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path).columns
    lines = file_lines(spark, path)
    starts = split_starts(split_ends(lines)).select(F.xxhash64("file", "block").alias("key"), "inside")
    begun = sorted((row["key"], row["inside"]) for row in starts.collect())
    splits = np.array([key for key, _ in begun], np.int64)
    inside = np.array([state for _, state in begun], bool)
    pieces = split_records(lines, splits, inside)
    whole = pieces.where(F.col("kind") == WHOLE).select("header", "record")
    if inside.any():
        # The few fragments are read for their order and for their texts.
        cut = cut_lineage(pieces.where(F.col("kind") != WHOLE))
        whole = whole.unionByName(stitched(cut).select("header", "record"))
    schema = StructType([StructField(name, StringType()) for name in names])
    record = F.from_csv("record", schema.toDDL(), {**options, "header": "false"})
    rows = whole.where(~F.col("header") & (F.col("record") != "")).select(record.alias("row"))
    return rows.select([F.col("row").getField(name).alias(name) for name in names])
