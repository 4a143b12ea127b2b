"""Benchmark passages in training documents, found by a broadcast set of word windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.text import (
    alphanumeric_table,
    bounded_batches,
    id_and_text,
    slices,
    string_buffers,
    whole_text,
    window_hashes,
    words_of,
)
from reviewlens.storage import scratch_path

# Windows that are broadcast together (56 MB); a larger benchmark is worked through in blocks.
BLOCK_WINDOWS = 2_000_000

SPANS = "array<struct<first:long,stop:long,byte_first:long,byte_stop:long>>"
SCHEMA = f"doc_id long, content long, n_words long, spans {SPANS}, owners array<long>"


def _windows(hashes: np.ndarray, first: np.ndarray, size: int):
    """Where windows of ``size`` words lie inside one text: their hashes and first words."""
    found = window_hashes(hashes, size)
    check = window_hashes(hashes, size, seed=2)
    inside = np.ones(len(found), bool)
    for border in first[1:-1]:
        inside[max(0, border - size + 1) : border] = False
    place = np.flatnonzero(inside)
    return found[place], check[place], place


def benchmark_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(item_id string, length, hash, proof) of every distinct window of the items.

    A window is ``size`` consecutive words; an item with fewer words, but not none, is one window.
    """
    bounded_batches(items.sparkSession)
    table = alphanumeric_table()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column(1), table)
            count = np.diff(words.first)
            for i, item in enumerate(batch.column(0).to_pylist()):
                if not count[i]:
                    continue
                own = words.hashes[words.first[i] : words.first[i + 1]]
                length = min(size, len(own))
                pairs = np.stack(
                    [window_hashes(own, length), window_hashes(own, length, seed=2)], axis=1
                )
                pairs = np.unique(pairs, axis=0).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item] * len(pairs), pa.string()),
                        pa.array(np.full(len(pairs), length, np.int32)),
                        pa.array(pairs[:, 0]),
                        pa.array(pairs[:, 1]),
                    ],
                    names=["item_id", "length", "hash", "proof"],
                )

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    return rows.mapInArrow(cut, "item_id string, length int, hash long, proof long")


def _scan(docs: DataFrame, block: dict, path: str, all_rows: bool) -> None:
    """Writes the hits of one block of windows, by whole text: all documents, or those with hits."""
    table = alphanumeric_table()
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches, "text"):
            words = words_of(batch.column(2), table)
            hits = []
            for length, (keys, proofs, group, most) in known["by_length"].items():
                found, check, place = _windows(words.hashes, words.first, length)
                begin = np.searchsorted(keys, found)
                for k in range(most):
                    at = np.minimum(begin + k, len(keys) - 1)
                    # The second hash verifies a hit of the first: 128 bits in all.
                    same = np.flatnonzero((keys[at] == found) & (proofs[at] == check))
                    hits.append((place[same], np.full(len(same), length), group[at[same]]))
            yield _hit_rows(batch, words, hits)

    rows = docs.mapInArrow(find, SCHEMA)
    (rows if all_rows else rows.where(F.size("spans") > 0)).write.parquet(path)
    shared.destroy()


def _hit_rows(batch: pa.RecordBatch, words, hits: list) -> pa.RecordBatch:
    place = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
    length = np.concatenate([h[1] for h in hits]) if hits else np.zeros(0, np.int64)
    group = np.concatenate([h[2] for h in hits]) if hits else np.zeros(0, np.int64)
    order = np.argsort(place, kind="stable")
    place, length, group = place[order], length[order], group[order]
    doc = np.searchsorted(words.first, place, "right") - 1
    bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
    offsets, _ = string_buffers(batch.column(2))
    spans, found = [], []
    for i in range(batch.num_rows):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            spans.append([])
            found.append([])
            continue
        start, stop = place[a:b], np.maximum.accumulate(place[a:b] + length[a:b])
        new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]]))
        first, last = start[new], stop[np.concatenate([new[1:] - 1, [len(stop) - 1]])]
        base = words.first[i]
        spans.append(
            [
                {
                    "first": int(f - base),
                    "stop": int(s - base),
                    "byte_first": int(words.starts[f] - offsets[i]),
                    "byte_stop": int(words.ends[s - 1] - offsets[i]),
                }
                for f, s in zip(first, last)
            ]
        )
        found.append(np.unique(group[a:b]))
    kinds = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "stop", "byte_first", "byte_stop")]))
    return pa.RecordBatch.from_arrays(
        [
            batch.column(0),
            batch.column(1),
            pa.array(np.diff(words.first).astype(np.int64)),
            pa.array(spans, kinds),
            pa.array(found, pa.list_(pa.int64())),
        ],
        names=["doc_id", "content", "n_words", "spans", "owners"],
    )


def _block(rows: list) -> dict:
    """The block of a list of windows; they need no owners."""
    length = np.array([r.length for r in rows], np.int64)
    hashes = np.array([r.hash % 2**64 for r in rows], np.uint64)
    proofs = np.array([r.proof % 2**64 for r in rows], np.uint64)
    return _sorted_block(length, hashes, proofs, np.zeros(len(rows), np.int64))


def _sorted_block(length: np.ndarray, hashes: np.ndarray, proofs: np.ndarray, owners: np.ndarray) -> dict:
    """By window length: sorted hashes, their second hashes and owners, and how many at most share
    a first hash."""
    out = {}
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        own = own[np.lexsort([proofs[own], hashes[own]])]
        keys = hashes[own]
        most = int(np.unique(keys, return_counts=True)[1].max())
        out[int(n)] = (keys, proofs[own], owners[own], most)
    return {"by_length": out}


def find_passages(
    docs: DataFrame, items: DataFrame, size: int = 10, block_windows: int = BLOCK_WINDOWS
) -> DataFrame:
    """Where documents hold windows of benchmark items.

    ``docs``: doc_id, text; ``items``: item_id, text. Result, one row per row of ``docs``: doc_id,
    n_words, spans (disjoint runs of hit words: first and stop word, first and stop byte of the
    UTF-8 text), items (ids, as strings, of all items with a window in the document).

    Words are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. The
    distinct windows are counted first and dealt by hash to blocks of about ``block_windows``. Each
    block is collected as Arrow columns, broadcast and held against all documents, its hits are
    written to the shared folder and its broadcast is destroyed before the next. Item ids stay in
    Spark: a window carries a hash of the set of its items, and the sets that were hit are joined to
    the hits. Texts are scanned whole, in numpy, and are never shuffled; what the blocks found is
    merged by id and a hash of the text.

    Null texts and texts without words have no words and no hits; an item without words has no
    window; an item repeated, or a window that several items share, counts for each item id. With no
    items, no hits; with no documents, no rows. Ids may be null or come in several rows, each of which
    gives a row, whatever the number of blocks. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = id_and_text(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("content"), "text"
    )
    path = scratch_path(spark, "passages")
    benchmark_windows(items, size).distinct().write.parquet(f"{path}/windows")
    windows = spark.read.parquet(f"{path}/windows")
    key = ["length", "hash", "proof"]
    # The items of a window, as one number that does not depend on their order.
    windows.groupBy(*key).agg(F.bit_xor(F.xxhash64("item_id")).alias("owners")).write.parquet(f"{path}/owned")
    owned = spark.read.parquet(f"{path}/owned")
    n_blocks = -(-owned.count() // block_windows) or 1
    for k in range(n_blocks):
        own = owned.where(F.pmod("hash", F.lit(n_blocks)) == k).toArrow()
        columns = [own.column(n).to_numpy() for n in ("length", "hash", "proof", "owners")]
        block = _sorted_block(columns[0], columns[1].view(np.uint64), columns[2].view(np.uint64), columns[3])
        _scan(docs, block, f"{path}/hits/block={k}", k == 0)
    found = spark.read.schema(f"{SCHEMA}, block int").parquet(f"{path}/hits")
    rows = found.where("block = 0").select("doc_id", "content", "n_words")
    # Rows with one id and text have the same hits: one of them stands for all.
    hits = found.where(F.size("spans") > 0).dropDuplicates(["doc_id", "content", "block"])
    spans = hits.groupBy("doc_id", "content").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")
    )
    owners = hits.select("doc_id", "content", F.explode("owners").alias("owners")).distinct()
    one = owned.join(owners.select("owners").distinct(), "owners", "left_semi").groupBy("owners").agg(
        F.min(F.struct(*key)).alias("window")
    )
    sets = windows.join(one.select("owners", "window.*"), key).select("owners", "item_id")
    named = (
        owners.join(sets, "owners")
        .select("doc_id", "content", "item_id")
        .distinct()
        .groupBy("doc_id", "content")
        .agg(F.array_sort(F.collect_list(F.struct("item_id"))).alias("items"))
    )
    spans = spans.select(F.col("doc_id").alias("d"), F.col("content").alias("c"), _merge_spans().alias("spans"))
    named = named.select(F.col("doc_id").alias("e"), F.col("content").alias("f"), "items.item_id")
    return (
        rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("content") == F.col("c")), "left")
        .join(named, F.col("doc_id").eqNullSafe(F.col("e")) & (F.col("content") == F.col("f")), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("spans", F.array().cast(SPANS)).alias("spans"),
            F.coalesce("item_id", F.array().cast("array<string>")).alias("items"),
        )
    )


def _merge_spans():
    """Sorted spans with those that overlap or touch made one."""
    kind = "array<struct<first:bigint,stop:bigint,byte_first:bigint,byte_stop:bigint>>"
    return F.expr(
        f"""aggregate(spans, CAST(array() AS {kind}), (done, s) -> CASE
              WHEN size(done) = 0 OR element_at(done, -1).stop < s.first THEN array_append(done, s)
              ELSE array_append(slice(done, 1, size(done) - 1), named_struct(
                'first', element_at(done, -1).first,
                'stop', greatest(element_at(done, -1).stop, s.stop),
                'byte_first', element_at(done, -1).byte_first,
                'byte_stop', greatest(element_at(done, -1).byte_stop, s.byte_stop))) END)"""
    )


def hit_words(spans: str = "spans"):
    """Number of words inside the spans."""
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + s.stop - s.first)")


def remove_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the found spans cut out of ``text``; all other columns as they are.

    Ids must be distinct. Documents without spans keep their text unchanged, nulls included.
    """

    @F.pandas_udf("string")
    def without(text: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, own in zip(text, spans):
            if value is not None and own is not None:
                raw, at, pieces = value.encode(), 0, []
                for span in own:
                    pieces.append(raw[at : span["byte_first"]])
                    at = span["byte_stop"]
                value = b"".join([*pieces, raw[at:]]).decode()
            out.append(value)
        return pd.Series(out, dtype=object)

    hits = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("hit_id"), "spans")
    joined = docs.join(hits, F.col("doc_id") == F.col("hit_id"), "left")
    return joined.withColumn("text", without(F.col("text"), F.col("spans"))).select(*docs.columns)
