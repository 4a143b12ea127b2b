"""Repeated passages found by recompression: runs and pairs of tokens get names, round by round."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.text import (
    bounded_batches,
    mix,
    slices,
    spaced_table,
    span_hashes,
    window_hashes,
    words_of,
)
from reviewlens.storage import cut_lineage

ROUNDS = 16
# Rounds whose symbols, where they cover a window or more, reveal long repeats.
LONG_ROUNDS = (8, 12, 16)
# (round, symbols in a row) that stand for a window, the first that fits into it.
ANCHORS = ((2, 3), (2, 2), (1, 3), (1, 2), (0, 1))

_PAIR, _RUN = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


@dataclass
class Level:
    """The symbols of several texts after some rounds, in order.

    A symbol covers the words from ``start`` to ``stop``. The words from ``need_start`` to
    ``need_stop`` alone decide that it stands there: wherever the same words occur, the same symbol
    stands at the same place among them. At a text's edge the need reaches beyond the text, as
    nothing inside tells what would stand next in another text.
    """

    name: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    need_start: np.ndarray
    need_stop: np.ndarray
    text: np.ndarray


def first_level(hashes: np.ndarray, first: np.ndarray) -> Level:
    """Every word is a symbol; its name is its hash."""
    place = np.arange(len(hashes))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Level(hashes, place, place + 1, place, place + 1, text)


def _edges(level: Level, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far to the left and right a symbol's need reaches if it includes both neighbours."""
    n = len(level.name)
    same = level.text[1:] == level.text[:-1]
    before = np.where(np.concatenate([[False], same])[:n], np.roll(level.need_start, 1), first[level.text] - 1)
    after = np.where(np.concatenate([same, [False]])[:n], np.roll(level.need_stop, -1), first[level.text + 1] + 1)
    return np.minimum(before, level.need_start), np.maximum(after, level.need_stop)


def _take(level: Level, head: np.ndarray, last: np.ndarray, name, need_start, need_stop) -> Level:
    return Level(name, level.start[head], level.stop[last], need_start, need_stop, level.text[head])


def pair_round(level: Level, first: np.ndarray, number: int) -> Level:
    """Names all pairs of a left and a right symbol; a hash of the name and round says which is which.

    Names are hashes of what they stand for, so all tasks give equal pairs the same name without
    a shared dictionary.
    """
    n = len(level.name)
    if not n:
        return level
    right = (mix(level.name ^ np.uint64(number * 2654435761 + 17)) >> np.uint64(63)).astype(bool)
    joined = ~right[:-1] & right[1:] & (level.text[1:] == level.text[:-1])
    tail = np.concatenate([[False], joined])
    head = np.flatnonzero(~tail)
    pair = np.concatenate([joined, [False]])[head]
    last = head + pair
    name = level.name[head].copy()
    name[pair] = mix(name[pair] * _PAIR + level.name[last[pair]])
    wide_start, wide_stop = _edges(level, first)
    need_start = np.where(pair | ~right[head], level.need_start[head], wide_start[head])
    need_stop = np.where(pair, level.need_stop[last], np.where(right[head], level.need_stop[head], wide_stop[head]))
    return _take(level, head, last, name, need_start, need_stop)


def run_round(level: Level, first: np.ndarray) -> Level:
    """Names all runs of two or more equal symbols by the symbol and the length."""
    n = len(level.name)
    if not n:
        return level
    same = (level.name[1:] == level.name[:-1]) & (level.text[1:] == level.text[:-1])
    head = np.flatnonzero(np.concatenate([[True], ~same]))
    last = np.concatenate([head[1:], [n]]) - 1
    size = (last - head + 1).astype(np.uint64)
    name = level.name[head].copy()
    run = size > 1
    name[run] = mix(name[run] * _RUN + size[run])
    wide_start, wide_stop = _edges(level, first)
    return _take(level, head, last, name, wide_start[head], wide_stop[last])


def levels(hashes: np.ndarray, first: np.ndarray, rounds: int, runs_every: int = 4):
    """The levels from the words on; after every ``runs_every`` pair rounds, runs are named."""
    level = first_level(hashes, first)
    yield level
    for number in range(1, rounds + 1):
        if number % runs_every == 0:
            level = run_round(level, first)
        level = pair_round(level, first, number)
        yield level


@dataclass
class Names:
    """What a batch of texts says about its windows.

    Long symbols: name, proof (a second hash of the words), text, first word and end. Windows: their
    first words, texts, and the name of the anchor that stands for each. The lowest bit of a name
    says which of the two kinds it is.
    """

    long: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    window: np.ndarray
    window_text: np.ndarray
    anchor: np.ndarray


def _anchors(level: Level, first: np.ndarray, size: int, count: int, best: np.ndarray) -> np.ndarray:
    """For every word, the least name of ``count`` symbols in a row that the window there decides."""
    n = len(level.name) - count + 1
    found = np.full(len(best), ~np.uint64(0), np.uint64)
    if n <= 0:
        return found
    key = window_hashes(level.name, count, seed=count)
    start = np.minimum.reduce([level.need_start[k : k + n] for k in range(count)])
    stop = np.maximum.reduce([level.need_stop[k : k + n] for k in range(count)])
    text = level.text[:n]
    low, high = first[text], first[text + 1]
    good = (level.text[count - 1 :] == text) & (start >= low) & (stop <= high) & (stop - start <= size)
    key, start, stop, low, high = (x[good] for x in (key, start, stop, low, high))
    for back in range(size):
        at = start - back
        fits = (at + size >= stop) & (at >= low) & (at + size <= high)
        np.minimum.at(found, at[fits], key[fits])
    return found


def names_of(hashes: np.ndarray, first: np.ndarray, size: int) -> Names:
    """Long symbols and anchored windows of a batch of texts.

    Equal windows get equal anchors wherever they stand: the candidates are exactly the symbols
    that the window's own words decide, and the least of them is a function of their names. A single
    word always qualifies, so no window is without an anchor.
    """
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = np.arange(len(hashes))
    inside = place + size <= first[text + 1]
    none = ~np.uint64(0)
    anchor = np.full(len(hashes), none, np.uint64)
    low_levels, long = [], []
    for number, level in enumerate(levels(hashes, first, ROUNDS)):
        if number <= max(r for r, _ in ANCHORS):
            low_levels.append(level)
        if number in LONG_ROUNDS:
            wide = np.flatnonzero(level.stop - level.start >= size)
            long.append([level.name[wide], level.text[wide], level.start[wide], level.stop[wide]])
    for number, count in ANCHORS:
        missing = inside & (anchor == none)
        if missing.any():
            found = _anchors(low_levels[number], first, size, count, anchor)
            anchor[missing] = found[missing]
    name, owner, start, stop = (np.concatenate(parts) for parts in zip(*long))
    proof = span_hashes(hashes, start, stop)
    window = np.flatnonzero(inside)
    return Names(
        (mix(name) | np.uint64(1), proof, owner, start, stop),
        window,
        text[window],
        anchor[window] & ~np.uint64(1),
    )


def _one_per_document(name: np.ndarray, proof: np.ndarray, doc: np.ndarray, any_other: np.ndarray):
    """Distinct (name, proof, doc) of a batch: who goes out to meet other batches, and who need not.

    The smallest document with a name goes out for all. The others know already that a smaller
    document has it, and travel apart, each to a place of its own.
    """
    order = np.lexsort((doc, proof, name))
    name, proof, doc, any_other = name[order], proof[order], doc[order], any_other[order]
    new_name = np.ones(len(name), bool)
    new_name[1:] = (name[1:] != name[:-1]) | (proof[1:] != proof[:-1])
    new = new_name.copy()
    new[1:] |= doc[1:] != doc[:-1]
    name, proof, doc, any_other, leads = (x[new] for x in (name, proof, doc, any_other, new_name))
    # For an anchor it is enough that any other document of the batch has it.
    shared = np.zeros(len(name), bool)
    shared[:-1] = ~leads[1:]
    known = ~leads | (any_other & shared)
    return name, proof, doc, leads, known


_ROWS = "name long, proof long, doc long, known boolean"


def _rows(name, proof, doc, leads, known) -> pa.RecordBatch:
    proof = proof.copy()
    proof[~leads] = mix(name[~leads] ^ mix(doc[~leads].astype(np.uint64)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(name.view(np.int64)),
            pa.array(proof.view(np.int64)),
            pa.array(doc.astype(np.int64)),
            pa.array(known),
        ],
        names=["name", "proof", "doc", "known"],
    )


def _met(rows: DataFrame) -> DataFrame:
    """(doc, name) of the rows that share their name with a smaller, or for anchors any, document."""
    group = Window.partitionBy("name", "proof")
    met = rows.withColumns(
        {"least": F.min("doc").over(group), "most": F.max("doc").over(group)}
    )
    is_long = F.col("name").bitwiseAND(1) == 1
    return met.where(
        F.col("known")
        | (F.col("least") < F.col("doc"))
        | (~is_long & (F.col("most") > F.col("doc")))
    ).select("doc", "name")


def _by_document(flags: DataFrame, name: str) -> DataFrame:
    return flags.groupBy(F.col("doc").alias(f"{name}_doc")).agg(F.collect_set("name").alias(name))


def _flagged(lists: pa.Array, k: int) -> np.ndarray:
    value = lists[k]
    if not value.is_valid:
        return np.zeros(0, np.uint64)
    return np.sort(value.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _long_spans(names: Names, text: int, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of a text's flagged long symbols."""
    name, _, owner, start, stop = names.long
    own = np.flatnonzero(owner == text)
    hit = own[_is_in(name[own], flags)]
    return start[hit], stop[hit]


def _doubtful(names: Names, first: np.ndarray, text: int, flags: np.ndarray, size: int) -> np.ndarray:
    """Windows with a shared anchor that do not lie inside a single flagged long symbol."""
    a, b = np.searchsorted(names.window_text, [text, text + 1])
    window = names.window[a:b][_is_in(names.anchor[a:b], flags)]
    start, stop = _long_spans(names, text, flags)
    depth = np.zeros(first[text + 1] - first[text] + 1, np.int64)
    np.add.at(depth, start - first[text], 1)
    np.add.at(depth, stop - size + 1 - first[text], -1)
    return window[np.cumsum(depth)[window - first[text]] == 0]


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """Documents without the words of passages that a document with a smaller id has, too.

    ``docs``: doc_id, text. A window is ``size`` consecutive words of one document, split at space
    and 09 to 0D. Every word covered by a window whose words also start in a document with a
    smaller doc_id is removed; windows are judged on the input. Result, one row per row: doc_id, text
    (the kept words joined by one space), n_words, n_removed.

    First, texts are recompressed where they are read: rounds name runs and pairs of symbols by
    hashes, so equal passages have equal symbols inside without any task asking another. Long
    symbols reveal long repeats at once; for all other windows, an anchor of a few low symbols
    says which may repeat. One row per name and batch meets the others in a shuffle, so a passage
    that a third of the documents share costs one row per batch. Second, only windows with a shared
    anchor that no single long symbol explains are hashed (128 bits) and meet the same way, which
    decides them exactly. Third, each document's words are removed.

    Null, empty and short texts keep all their words. Rows with equal ids are not smaller than each
    other; every row of an id is judged by the id. A null id is larger than any other and no one's
    source. Other columns are ignored; no documents, no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    top = 2**63 - 1
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(top)).alias("doc"),
        "text",
    )
    table = spaced_table(lower=False)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column(1), table)
            ids = batch.column(0).to_numpy()
            names = names_of(words.hashes, words.first, size)
            long, proof, owner = names.long[:3]
            anchors = np.zeros(len(names.anchor), np.uint64)
            yield _rows(
                *_one_per_document(
                    np.concatenate([long, names.anchor]),
                    np.concatenate([proof, anchors]),
                    ids[np.concatenate([owner, names.window_text])],
                    np.concatenate([np.zeros(len(long), bool), np.ones(len(anchors), bool)]),
                )
            )

    flags = cut_lineage(_by_document(_met(docs.select("doc", "text").mapInArrow(name, _ROWS)), "names"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column(2), table)
            ids = batch.column(1).to_numpy()
            names = names_of(words.hashes, words.first, size)
            windows = [
                _doubtful(names, words.first, k, _flagged(batch.column(3), k), size)
                for k in range(batch.num_rows)
            ]
            doc = np.repeat(ids, [len(w) for w in windows])
            at = np.concatenate(windows)
            yield _rows(
                *_one_per_document(
                    window_hashes(words.hashes, size)[at] | np.uint64(1),
                    window_hashes(words.hashes, size, seed=2)[at],
                    doc,
                    np.zeros(len(at), bool),
                )
            )

    # The texts dealt by document serve the second and the third step: one exchange, used twice.
    named = docs.join(flags, F.col("doc") == F.col("names_doc"), "left")
    candidates = named.select("doc_id", "doc", "text", "names")
    repeats = _by_document(_met(candidates.mapInArrow(digest, _ROWS)), "windows")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = words_of(batch.column(2), table)
            first = words.first
            named = [_flagged(batch.column(3), k) for k in range(batch.num_rows)]
            hit = [_flagged(batch.column(4), k) for k in range(batch.num_rows)]
            names = names_of(words.hashes, first, size) if any(map(len, named)) else None
            digests = window_hashes(words.hashes, size) | np.uint64(1)
            texts, counts, removed = [], np.diff(first), np.zeros(batch.num_rows, np.int64)
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = (text or "").encode().split()
                gone = np.zeros(len(own) + 1, np.int64)
                if len(named[k]):
                    start, stop = _long_spans(names, k, named[k])
                    np.add.at(gone, start - first[k], 1)
                    np.add.at(gone, stop - first[k], -1)
                if len(hit[k]) and len(own) >= size:
                    start = np.flatnonzero(_is_in(digests[first[k] : first[k + 1] - size + 1], hit[k]))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + size, -1)
                lost = np.cumsum(gone)[:-1] > 0
                removed[k] = lost.sum()
                if removed[k]:
                    own = [own[i] for i in np.flatnonzero(~lost)]
                texts.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts.astype(np.int64)), pa.array(removed)],
                names=["doc_id", "text", "n_words", "n_removed"],
            )

    last = named.join(repeats, F.col("doc") == F.col("windows_doc"), "left").select(
        "doc_id", "doc", "text", "names", "windows"
    )
    return last.mapInArrow(remove, "doc_id long, text string, n_words long, n_removed long")
