"""Near-duplicate documents: min-max hashing, banding, exact verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.components import components
from reviewlens.llm.text import (
    bounded_batches,
    mix,
    slices,
    spaced_table,
    window_hashes,
    words_of,
)
from reviewlens.storage import cut_lineage, scratch_path, stored

BANDS = 24
# Two permutations, so four signature values, make a band.
PERMUTATIONS_PER_BAND = 2
# Documents held against one copy of a centre's text in one group, and documents of a block.
MEMBERS = 256
# Shingles of a block, on average; a longer document makes the block longer.
SHINGLES = 500_000
# Columns of an incidence matrix.
COLUMNS = 8192


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words = words_of(texts, spaced_table(lower=True))
    windows = window_hashes(words.hashes, size)
    out = []
    for a, b in zip(words.first, words.first[1:]):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        else:
            out.append(window_hashes(words.hashes[a:b], int(b - a)) if b > a else words.hashes[:0])
    return out


def _set_hashes(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    one = np.add.reduceat(mix(values), starts)
    two = np.bitwise_xor.reduceat(mix(values + np.uint64(0x51ED270B)), starts)
    return one, two


def min_max_signatures(values: np.ndarray, starts: np.ndarray, bands: int, seed: int) -> np.ndarray:
    """One row of band keys for each set.

    Each permutation is evaluated once and gives two signature values, the smallest and the largest
    permuted shingle; both agree between two sets with the probability of their resemblance.
    """
    draw = np.random.default_rng(seed).integers(1, 1 << 63, (bands, PERMUTATIONS_PER_BAND, 2), dtype=np.uint64)
    out = np.empty((len(starts), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(starts), band, np.uint64)
        for add, factor in draw[band]:
            permuted = (values ^ add) * (factor * np.uint64(2) + np.uint64(1))
            for extreme in (np.minimum, np.maximum):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + extreme.reduceat(permuted, starts))
        out[:, band] = key
    return out


def signatures(docs: DataFrame, size: int, bands: int = BANDS, seed: int = 5) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, bands) of each document; sets without shingles have no bands."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(1), size)
            counts = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(counts)
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            keys = np.zeros((0, bands), np.uint64)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                h1[full], h2[full] = _set_hashes(values, starts)
                keys = min_max_signatures(values, starts, bands, seed)
            edges = np.concatenate([[0], np.cumsum(counts > 0)]) * bands
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(edges.astype(np.int32)), pa.array(keys.ravel().view(np.int64))
                    ),
                ],
                names=["doc_id", "n_shingles", "h1", "h2", "bands"],
            )

    return docs.mapInArrow(
        sign, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"
    )


def verify_pairs(docs: DataFrame, pairs: DataFrame, size: int, share: float) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have a resemblance of at least ``share``.

    ``pairs``: a, a_hash, b, b_hash, distinct; the hash says which set an id stands for, should it
    come with several texts. Every b travels to its a; an a with many partners gets one group, and one
    copy of its text, for every MEMBERS of them, so no task holds more than one set and a batch.
    """
    percent = round(100 * share)
    groups = pairs.groupBy("a", "a_hash").agg(
        F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("n_salts")
    )
    centres = groups.select(
        F.col("a").alias("id"),
        F.col("a_hash").alias("hash"),
        "a",
        "a_hash",
        F.explode(F.sequence(F.lit(0), F.col("n_salts") - 1)).alias("salt"),
        F.lit(0).alias("role"),
    )
    members = pairs.join(groups, ["a", "a_hash"]).select(
        F.col("b").alias("id"),
        F.col("b_hash").alias("hash"),
        "a",
        "a_hash",
        F.pmod(F.xxhash64("b"), F.col("n_salts")).cast("int").alias("salt"),
        F.lit(1).alias("role"),
    )
    wanted = docs.join(centres.unionByName(members), F.col("doc_id") == F.col("id"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set = None, None
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column(0), size)
            left, right = [], []
            a, mark, salt, role, ids, hashes = (batch.column(k).to_pylist() for k in range(1, 7))
            for k, own in enumerate(sets):
                if not len(own) or int(_set_hashes(own, np.zeros(1, np.int64))[0].view(np.int64)[0]) != hashes[k]:
                    continue
                if role[k] == 0:
                    centre, centre_set = (a[k], mark[k], salt[k]), own
                elif centre == (a[k], mark[k], salt[k]):
                    both = len(np.intersect1d(centre_set, own, assume_unique=True))
                    if 100 * both >= percent * (len(centre_set) + len(own) - both):
                        left.append(a[k])
                        right.append(ids[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"]
            )

    key = ["a", "a_hash", "salt"]
    dealt = wanted.select("text", *key, "role", "id", "hash").repartition(*key)
    return dealt.sortWithinPartitions(*key, "role", "id").mapInArrow(compare, "a long, b long")


def compare_groups(docs: DataFrame, rows: DataFrame, size: int, share: float) -> DataFrame:
    """(a, b): connections among all sufficiently resembling documents within each group.

    ``rows``: group, id, hash, n (shingles), part (the component known so far). The most frequent part
    of a group is its core; only pairs with a document outside it are of interest. Both sides are cut
    into blocks of a bounded number of documents and shingles, and each pair of blocks with an outside
    one is a task's unit of work: all its intersections are counted at once by a product of
    incidence matrices, and what leaves the task is one connection for each connected document.
    """
    percent = round(100 * share)
    frequent = rows.groupBy("group", "part").agg(F.count(F.lit(1)).alias("times"))
    core = frequent.groupBy("group").agg(
        F.max_by("part", F.struct("times", "part")).alias("core")
    )
    sided = rows.join(core, "group").withColumn("outside", F.col("part") != F.col("core"))
    sizes = sided.groupBy("group").agg(
        *[
            F.ceil(
                F.greatest(
                    F.sum(F.when(side, 1.0).otherwise(0.0)) / MEMBERS,
                    F.sum(F.when(side, F.col("n")).otherwise(0)) / SHINGLES,
                )
            ).cast("int").alias(name)
            for name, side in (("n_out", F.col("outside")), ("n_core", ~F.col("outside")))
        ],
    )
    blocks = F.when(F.col("outside"), F.col("n_out")).otherwise(F.col("n_core"))
    placed = sided.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))

    def upto(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def unit(first: Column, second: Column, second_outside: bool) -> Column:
        return F.struct(first.alias("i"), second.alias("j"), F.lit(second_outside).alias("out"))

    own = F.col("block")
    outside = F.concat(
        F.transform(upto(F.col("n_out")), lambda k: unit(F.least(own, k), F.greatest(own, k), True)),
        F.transform(upto(F.col("n_core")), lambda k: unit(own, k, False)),
    )
    inside = F.transform(upto(F.col("n_out")), lambda k: unit(k, own, False))
    dealt = placed.select(
        F.col("id"), "hash", "group", F.explode(F.when(F.col("outside"), outside).otherwise(inside)).alias("unit")
    )
    wanted = docs.join(dealt, F.col("doc_id") == F.col("id")).select(
        "text", "id", "hash", "group", "unit.i", "unit.j", "unit.out"
    )
    key = ["group", "i", "j", "out"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, sets = None, [], []
        for batch in slices(batches, "text"):
            found = shingle_sets(batch.column(0), size)
            columns = [batch.column(k).to_pylist() for k in range(1, 7)]
            for own, (doc, mark, *unit) in zip(found, zip(*columns)):
                if not len(own) or _first_hash(own) != mark:
                    continue
                if unit != current:
                    yield _connections(ids, sets, percent)
                    current, ids, sets = unit, [], []
                ids.append(doc)
                sets.append(own)
        yield _connections(ids, sets, percent)

    sorted_units = wanted.repartition(*key).sortWithinPartitions(*key, "id")
    return sorted_units.mapInArrow(compare, "a long, b long")


def _first_hash(own: np.ndarray) -> int:
    return int(_set_hashes(own, np.zeros(1, np.int64))[0].view(np.int64)[0])


def _connections(ids: list[int], sets: list[np.ndarray], percent: int) -> pa.RecordBatch:
    """Each document that resembles another of the list, with the smallest id reachable from it."""
    counts = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((len(sets), len(sets)), np.int64)
    if len(sets) > 1:
        owner = np.repeat(np.arange(len(sets)), counts)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # A shingle of a single document adds to no intersection.
        owner, column = owner[times[column] > 1], column[times[column] > 1]
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            incidence = np.zeros((len(sets), COLUMNS), np.float32)
            incidence[owner[a:b], column[a:b] - low] = 1
            both += (incidence @ incidence.T).astype(np.int64)
    linked = 100 * both >= percent * (counts[:, None] + counts[None, :] - both)
    np.fill_diagonal(linked, False)
    label = np.array(ids, np.int64)
    while len(label):
        top = np.iinfo(np.int64).max
        least = np.minimum(label, np.where(linked, label[None, :], top).min(axis=1))
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.array(ids, np.int64)) if ids else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(label[moved], pa.int64()), pa.array(np.array(ids, np.int64)[moved], pa.int64())],
        names=["a", "b"],
    )


def _classes_of_one_id(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): connections among the classes in which an id stands that comes with several texts."""
    own = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2")
    ends = own.groupBy("doc_id").agg(
        F.min("h1").alias("l1"), F.max("h1").alias("m1"), F.min("h2").alias("l2"), F.max("h2").alias("m2")
    )
    several = ends.where("l1 <> m1 OR l2 <> m2").select("doc_id")
    found = own.join(several, "doc_id").distinct().join(classes.select("h1", "h2", "id"), ["h1", "h2"])
    least = found.groupBy("doc_id").agg(F.min("id").alias("a"))
    return found.join(least, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, size: int = 5, share: float = 0.8, bands: int = BANDS, seed: int = 5
) -> DataFrame:
    """Documents linked where their sets of ``size``-word shingles resemble by ``share`` or more.

    ``docs``: doc_id, text. Result, one row per row: doc_id, n_shingles, component_id (smallest id
    reachable), kept (doc_id = component_id).

    Words are split at space and 09 to 0D, A-Z count as lower case. Documents with equal sets form a
    class, and only one of each class is signed into buckets. In a first round, each member of a
    bucket is compared, on full sets, to two centres of the bucket, never to all others; the links found
    join most of a bucket into one component. In a second round, buckets that still hold several
    components are grouped by their smallest document and compared in blocks. So every pair that shares a
    bucket is either compared or already connected, and a pair at the threshold shares none
    with a probability of (1 - share**4)**bands, 3 in a million.

    Null, empty and word-free texts have no shingles and link with nothing. A repeated row is a copy.
    An id that comes with several texts is one node with the links of all. A null id links with
    nothing and is not kept. Other columns are ignored; no documents, no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    path = scratch_path(spark, "signatures")
    signatures(docs, size, bands, seed).write.parquet(path)
    signed = spark.read.parquet(path)
    classes = cut_lineage(
        signed.where("n_shingles > 0")
        .groupBy("h1", "h2")
        .agg(
            F.min("doc_id").alias("id"),
            F.first("n_shingles").alias("n"),
            F.first("bands").alias("bands"),
        )
        .where("id IS NOT NULL")
    )
    rows = classes.select("id", F.col("h1").alias("hash"), "n", F.posexplode("bands").alias("band", "key"))
    order = F.struct(F.xxhash64("id").alias("rank"), "id", "hash", "n")
    buckets = (
        rows.groupBy("band", "key")
        .agg(F.count(F.lit(1)).alias("size"), F.min(order).alias("low"), F.max(order).alias("high"))
        .where("size > 1")
    )
    active = cut_lineage(rows.join(buckets, ["band", "key"]))
    fits = F.least("n", "m") >= math.floor(100 * share) / 100 * F.greatest("n", "m")
    stars = None
    for centre in ("low", "high"):
        star = active.select(
            F.col(f"{centre}.id").alias("a"),
            F.col(f"{centre}.hash").alias("a_hash"),
            F.col("id").alias("b"),
            F.col("hash").alias("b_hash"),
            "n",
            F.col(f"{centre}.n").alias("m"),
        ).where((F.col("a") != F.col("b")) & fits)
        stars = star if stars is None else stars.unionByName(star)
    stars = stars.drop("n", "m").distinct()
    links = stored(verify_pairs(docs, stored(stars, "stars"), size, share), "pairs")
    parts = components(links)
    # Buckets that still hold several components. Their smallest document names the group, so the
    # many buckets that a family of near copies shares fall together.
    placed = active.join(parts.withColumnRenamed("node", "id"), "id", "left").select(
        "band", "key", "id", "hash", "n", F.coalesce("component", "id").alias("part")
    )
    mixed = (
        placed.groupBy("band", "key")
        .agg(F.min("part").alias("least"), F.max("part").alias("most"), F.min("id").alias("group"))
        .where("least <> most")
        .select("band", "key", "group")
    )
    opened = placed.join(mixed, ["band", "key"])
    grouped = opened.select("group", "id", "hash", "n", "part").distinct()
    more = compare_groups(docs, stored(grouped, "groups"), size, share)
    shared = _classes_of_one_id(signed, classes)
    members = components(links.unionByName(more).unionByName(shared), known=parts)
    found = classes.select("h1", "h2", "id").join(members.withColumnRenamed("node", "id"), "id", "left")
    found = found.select("h1", "h2", F.coalesce("component", "id").alias("component"))
    joined = signed.drop("bands").join(found, ["h1", "h2"], "left")
    linked = F.col("n_shingles") > 0
    return joined.select(
        "doc_id",
        "n_shingles",
        F.when(linked & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
