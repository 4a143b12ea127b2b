"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import components
from reviewlens.llm.text import bounded_batches
from reviewlens.storage import cut_lineage

# Vectors that one numpy step holds against each other; larger buckets are cut into such blocks.
BLOCK = 512


def plan_tables(rows: int, cosine: float, miss: float = 1e-6) -> tuple[int, int]:
    """(bits per table, tables) for so many vectors.

    Bits grow with the logarithm of the rows, so that buckets of unrelated vectors stay small; tables
    are as many as it takes for a pair exactly at ``cosine`` to be missed with probability ``miss``.
    """
    bits = min(30, max(6, math.ceil(math.log2(max(rows, 1) / 64 + 1))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def _usable(column: str = "embedding"):
    """No null or non-finite component, and not all zero."""
    bad = F.exists(
        column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return (
        F.col(column).isNotNull()
        & ~F.coalesce(bad, F.lit(True))
        & F.exists(column, lambda x: x != 0)
    )


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _signatures(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """Each class with its bucket number in every table."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("embedding"))
            sizes = np.diff(np.asarray(vectors.offsets))
            out = np.zeros((batch.num_rows, tables), np.int32)
            for size in np.unique(sizes):
                if size not in planes:
                    draw = np.random.default_rng([seed, int(size)])
                    planes[size] = draw.normal(size=(int(size), tables * bits))
                own = np.flatnonzero(sizes == size)
                values = vectors.take(pa.array(own)).flatten().to_numpy().reshape(-1, size)
                up = (_unit(values) @ planes[size] > 0).reshape(-1, tables, bits)
                out[own] = up @ weights
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "signs"])

    return classes.mapInArrow(
        sign, "id long, label string, copies long, embedding array<double>, signs array<int>"
    )


def _local_components(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id reachable over ``linked`` from each row."""
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], big).min(axis=1, initial=big))
        if (least == label).all():
            return label
        label = least


def _compare(group: dict, cosine: float) -> dict:
    """Links within one group, counting only pairs that share no earlier table's bucket.

    The rows of a group are a bucket, or two blocks of one; of two blocks, only pairs across count.
    """
    vectors = _unit(group["embedding"])
    near = vectors @ vectors.T >= cosine
    np.fill_diagonal(near, False)
    if group["across"]:
        near &= group["side"][:, None] != group["side"][None, :]
    found = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(found, found)]
    first, second = np.nonzero(near)
    signs = group["signs"][found][:, : group["table"]]
    new = np.ones(len(first), bool)
    for at in range(0, len(first), 1 << 16):
        part = slice(at, at + (1 << 16))
        new[part] = ~(signs[first[part]] == signs[second[part]]).any(axis=1)
    links = np.zeros(len(found), np.int64)
    np.add.at(links, first[new], group["copies"][found][second[new]])
    ids = group["id"][found]
    return {"id": ids, "links": links, "up": _local_components(near, ids)}


def _classes_of_one_id(keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, up): connections among the classes of an id that comes with several vectors."""
    ends = keyed.groupBy("vec_id").agg(
        F.min("h1").alias("l1"), F.max("h1").alias("m1"), F.min("h2").alias("l2"), F.max("h2").alias("m2")
    )
    several = ends.where("l1 <> m1 OR l2 <> m2").select("vec_id")
    own = keyed.select("vec_id", "h1", "h2").join(several, "vec_id").distinct()
    found = own.join(classes.select("h1", "h2", "id"), ["h1", "h2"])
    least = found.groupBy("vec_id").agg(F.min("id").alias("up"))
    return found.join(least, "vec_id").where("up <> id").select("id", "up").distinct()


def link_vectors(
    vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-6, seed: int = 11
) -> DataFrame:
    """Vectors of equal label with a cosine of at least ``cosine``, as components and link counts.

    ``vectors``: vec_id, embedding (array of numbers), label. Result, one row per row: vec_id,
    n_links (other rows linked directly), component_id (the smallest id reachable), kept
    (vec_id = component_id).

    Equal vectors of a label are one class with a count, so exact copies are never compared. A
    class goes to one bucket in each of several tables of random-hyperplane signs; only rows of one
    bucket are compared, by exact double-precision cosines, so no link is ever claimed below the
    threshold, and one at the threshold is missed with probability ``miss``. A bucket larger than
    BLOCK is cut into blocks and every pair of blocks is a group of its own: no task gets more
    than two blocks at a time. Groups return counts and local components, never their pairs; a pair
    that meets in several tables is counted in the first.

    Null, empty and zero vectors, vectors with a null or non-finite component, and rows with a null
    label link with nothing: n_links 0 and themselves as component. Vectors of different length
    never link. A row repeated is a copy. An id that comes with several vectors is one node: what is
    linked with any of them is in its component, while n_links counts a row's own links. A null id links with nothing and is not kept. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable())
    keyed = usable.withColumns(
        {"h1": F.xxhash64("label", "embedding"), "h2": F.xxhash64(F.lit(1), "label", "embedding")}
    )
    classes = keyed.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"),
        F.first("label").alias("label"),
        F.count(F.lit(1)).alias("copies"),
        F.first("embedding").alias("embedding"),
    )
    classes = cut_lineage(classes.select("id", "label", "copies", "embedding", "h1", "h2"))
    bits, tables = plan_tables(classes.count(), cosine, miss)
    signed = _signatures(
        classes.select("id", "label", "copies", "embedding"), bits, tables, seed
    )
    found = cut_lineage(_verify(signed, cosine))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    shared = _classes_of_one_id(keyed, classes)
    parts = components(found.where("id <> up").select("id", "up").unionByName(shared), "id", "up")
    per_class = (
        classes.select("id", "copies", "h1", "h2")
        .join(links, "id", "left")
        .join(parts.withColumnRenamed("node", "id"), "id", "left")
        .select(
            "h1",
            "h2",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("own"),
            F.coalesce("component", "id").alias("component"),
        )
    )
    linked = keyed.select("vec_id", "h1", "h2").join(per_class, ["h1", "h2"])
    result = linked.select("vec_id", "own", "component").unionByName(
        rows.where(F.col("vec_id").isNull() | F.col("label").isNull() | ~_usable()).select(
            "vec_id", F.lit(0).cast("long").alias("own"), F.col("vec_id").alias("component")
        )
    )
    return result.select(
        "vec_id",
        F.col("own").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )


def _verify(signed: DataFrame, cosine: float) -> DataFrame:
    """(id, links, up) from all groups; an id comes once for each group it has links in."""
    dealt = signed.select(
        "*",
        F.size("embedding").alias("dimension"),
        F.posexplode("signs").alias("table", "bucket"),
    )
    key = ["label", "dimension", "table", "bucket"]
    sizes = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = dealt.join(sizes, key).withColumns(
        {"blocks": blocks, "block": F.pmod(F.xxhash64("id"), blocks).cast("int")}
    )
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other")).alias("group"),
        "id",
        "copies",
        "embedding",
        "signs",
        "table",
        F.col("block"),
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "bucket",
        "label",
    )
    order = ["group", "table", "bucket", "label", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            joined = pa.Table.from_batches([batch])
            if rest is not None:
                joined = pa.concat_tables([rest, joined])
            done, rest = _split_last(joined, order)
            yield from _groups(done, order, cosine)
        if rest is not None:
            yield from _groups(rest, order, cosine)

    sorted_groups = met.repartition("group").sortWithinPartitions(*order)
    return sorted_groups.mapInArrow(compare, "id long, links long, up long")


def _borders(rows: pa.Table, order: list[str]) -> np.ndarray:
    """Where a new group begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for name in order:
        values = rows[name].combine_chunks()
        if pa.types.is_string(values.type):
            values = values.dictionary_encode().indices
        values = values.to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


def _split_last(rows: pa.Table, order: list[str]) -> tuple[pa.Table, pa.Table]:
    """All groups that are complete, and the last one, which may go on in the next batch."""
    borders = _borders(rows, order)
    last = int(borders[-1]) if len(borders) else 0
    return rows.slice(0, last), rows.slice(last)


def _groups(rows: pa.Table, order: list[str], cosine: float) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    borders = [*_borders(rows, order), rows.num_rows]
    column = {name: rows[name].combine_chunks() for name in rows.column_names}
    flat = {
        name: column[name].to_numpy()
        for name in ("id", "copies", "table", "block", "low", "high")
    }
    out = []
    for a, b in zip(borders, borders[1:]):
        if b - a < 2:
            continue
        part = {name: column[name].slice(a, b - a).flatten().to_numpy() for name in ("embedding", "signs")}
        out.append(
            _compare(
                {
                    "id": flat["id"][a:b],
                    "copies": flat["copies"][a:b],
                    "embedding": part["embedding"].reshape(b - a, -1),
                    "signs": part["signs"].reshape(b - a, -1),
                    "table": int(flat["table"][a]),
                    "side": flat["block"][a:b],
                    "across": flat["low"][a] != flat["high"][a],
                },
                cosine,
            )
        )
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[name] for o in out])) for name in ("id", "links", "up")],
            names=["id", "links", "up"],
        )
