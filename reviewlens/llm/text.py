"""Words of whole Arrow string columns as 64-bit numbers, without a Python step per word.

The bytes of many texts are classified by a table of 256 entries and each word gets a polynomial
hash from prefix sums. Texts of any length are worked through in slices that end between words.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts that one numpy step takes together, in bytes; a single longer text is taken alone.
BATCH_BYTES = 1 << 21

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2)
_CODES += np.uint64(1)


def worker_memory(name: str) -> dict:
    """A dict that lives as long as the Python process, over all of its tasks.

    Functions reach the workers by value, so a dict of this module would be new in every task.
    """
    return sys.__dict__.setdefault(f"_reviewlens_{name}", {})


def _lower(table: np.ndarray) -> np.ndarray:
    table[65:91] = np.arange(97, 123)
    return table


def spaced_table(lower: bool) -> np.ndarray:
    """Words are runs of bytes other than space and 09 to 0D; optionally A-Z become a-z."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table = _lower(table)
    table[0] = 255  # 0 means a separator, and no UTF-8 text has a byte 255
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


def alphanumeric_table() -> np.ndarray:
    """Words are runs of ASCII letters, digits and all that is not ASCII, with A-Z as a-z."""
    table = _lower(np.arange(256, dtype=np.uint8))
    table[:48] = 0
    table[58:65] = 0
    table[91:97] = 0
    table[123:128] = 0
    return table


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64-bit numbers over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values ^= values >> np.uint64(27)
    values *= np.uint64(0x94D049BB133111EB)
    values ^= values >> np.uint64(31)
    return values


def power(base: int, size: int) -> np.ndarray:
    """base**i modulo 2**64 for i below ``size`` or more."""
    powers = worker_memory("powers")
    found = powers.get(base)
    if found is None or len(found) < size:
        found = np.full(max(size, BATCH_BYTES), base, dtype=np.uint64)
        found[0] = 1
        found = np.cumprod(found, dtype=np.uint64)
        powers[base] = found
    return found


@dataclass
class Words:
    """Words of several texts, in order: their hashes, byte spans, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    def texts(self, word: np.ndarray | slice) -> list[bytes]:
        """The bytes of some words, as they stand in the text."""
        data = self.data
        return [data[a:b].tobytes() for a, b in zip(self.starts[word], self.ends[word])]


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    place = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    size = int(place[-1])
    flat = np.frombuffer(data, np.uint8)[:size] if size else np.zeros(0, np.uint8)
    return place.astype(np.int64), flat


def words_of(texts: pa.Array, table: np.ndarray, split: Callable | None = None) -> Words:
    """All words of a string column. No word crosses from one text into the next.

    ``split(bytes, inside, begins, closes)`` may cut words further and change the bytes that are
    hashed: it returns codes, begins and closes.
    """
    place, data = string_buffers(texts)
    hashes, starts, ends = [], [], []
    at, stop = int(place[0]), int(place[-1])
    while at < stop:
        to = _slice_end(data, table, place, at, stop)
        own = _words_between(data, table, place, at, to, split)
        hashes.append(own[0])
        starts.append(own[1])
        ends.append(own[2])
        at = to
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(none.astype(np.uint64), none, none, np.zeros(len(place), np.int64), data)
    begin = np.concatenate(starts)
    return Words(
        np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, place), data
    )


def _slice_end(data, table, place, at: int, stop: int) -> int:
    """Where a slice of about BATCH_BYTES ends: at a text's start, else after a separator."""
    to = at + BATCH_BYTES
    if to >= stop:
        return stop
    border = place[np.searchsorted(place, to, "right") - 1]
    if border > at:
        return int(border)
    while to < stop:
        gaps = np.flatnonzero(table[data[to : to + BATCH_BYTES]] == 0)
        if len(gaps):
            return to + int(gaps[0]) + 1
        to += BATCH_BYTES
    return stop


def _words_between(data, table, place, at: int, to: int, split):
    code = table[data[at:to]]
    inside = code != 0
    borders = place[np.searchsorted(place, at) : np.searchsorted(place, to)] - at
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[borders] = inside[borders]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    borders = borders[borders > 0] - 1
    closes[borders] = inside[borders]
    if split is not None:
        code, begins, closes = split(data[at:to], inside, begins, closes)
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    values = _CODES[code]
    values[~inside] = 0
    values *= power(BASE, len(code))[: len(code)]
    total = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    hashes = (total[end] - total[start]) * power(INVERSE, len(code))[start]
    hashes += (end - start).astype(np.uint64)
    return mix(hashes), start + at, end + at


def window_hashes(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """The hash of ``size`` consecutive words from each word on, as many as there are."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(mix(np.array([seed], np.uint64))[0] | np.uint64(1))
    total = hashes[:count].copy()
    for k in range(1, size):
        total *= factor
        total += hashes[k : k + count]
    return mix(total)


def span_hashes(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The hash of the words from ``start`` to ``stop``, wherever they stand."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * power(BASE, len(hashes))[: len(hashes)], out=total[1:])
    found = (total[stop] - total[start]) * power(INVERSE, len(hashes) + 1)[start]
    return mix(found + (stop - start).astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that each holds about BATCH_BYTES of text, or one longer text."""
    for batch in batches:
        place, _ = string_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(place, place[at] + BATCH_BYTES, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def bounded_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches at a few MB, however long the texts, unless the session says otherwise."""
    for key, value in (
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BATCH_BYTES)),
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "4096"),
    ):
        if key not in spark.conf.getAll:
            spark.conf.set(key, value)


def whole_text(column: str = "text") -> Column:
    """The text, with a null as an empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns under fixed names; whatever else the table has is not read."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
