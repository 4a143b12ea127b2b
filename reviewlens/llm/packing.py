"""Token sequences packed by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.text import (
    bounded_batches,
    slices,
    spaced_table,
    words_of,
    worker_memory,
)
from reviewlens.storage import scratch_path

CAPACITY = 2048
# Distinct units whose ids a Python worker remembers, at about 45 bytes each.
REMEMBERED_UNITS = 2_500_000

PIECES = (
    "doc_id long, start long, length int, ids array<int>, ids_crc32 long, doc_tokens long, "
    "task int, place long"
)


def _byte_kinds() -> np.ndarray:
    """0 separator, 1 letter, 2 digit, 3 ASCII mark, 4 anything that the tokeniser must see whole."""
    kinds = np.full(256, 4, np.uint8)
    kinds[33:127] = 3
    kinds[48:58] = 2
    kinds[65:91] = kinds[97:123] = 1
    # An apostrophe may begin a contraction, and "<" a special token.
    kinds[[ord("'"), ord("<")]] = 4
    kinds[[9, 10, 13, 32]] = 0
    return kinds


_KINDS = _byte_kinds()


def _split_units(raw: np.ndarray, inside: np.ndarray, begins: np.ndarray, closes: np.ndarray):
    """Cuts words where the vocabulary's splitter does: runs of letters, single digits, runs of marks.

    Letters are those of ASCII and of U+00C0 to U+00FF; they are hashed in lower case. A word with
    any other character, an apostrophe or "<" stays whole and as it is.
    """
    kind = _KINDS[raw]
    code = raw.copy()
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    letter = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)
    lead, second = lead[letter], second[letter]
    kind[lead] = kind[lead + 1] = 1
    number = np.cumsum(begins) - 1
    odd = np.zeros(int(number[-1]) + 1 if len(number) else 0, bool)
    odd[number[(kind == 4) & inside]] = True
    kind[inside & odd[number]] = 4
    kind[~inside] = 0
    code[(kind == 1) & (raw >= 65) & (raw <= 90)] += 32
    upper = lead[(kind[lead] == 1) & (second <= 0x9E)] + 1
    code[upper] += 32
    border = kind[1:] != kind[:-1]
    border |= kind[1:] == 2
    begins, closes = begins.copy(), closes.copy()
    begins[1:] |= border & inside[1:]
    closes[:-1] |= border & inside[:-1]
    return code, begins, closes


def _byte_characters() -> dict[int, str]:
    """The character that stands for a byte in byte-level vocabularies: printable ones themselves,
    the others in order from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


_CHARACTERS = _byte_characters()
_KINDS_ODD = frozenset(np.flatnonzero(_KINDS == 4).tolist())
# What a unit of letters outside ASCII may hold; every other such unit goes to the tokeniser whole.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


class WordIds:
    """Ids of texts, each distinct unit tokenised once as long as it is remembered.

    The vocabulary's normaliser and splitter never look across space, tab or line breaks, so the ids
    of a text are those of its words in a row, and most words fall into smaller units.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.table = spaced_table(lower=False)
        self.table[[11, 12]] = [11, 12]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of the units known so far
        self.where = np.zeros(0, np.int64)  # their number in the order they came
        self.begin = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _ids(self, unit: bytes) -> list[int]:
        if not _KINDS_ODD.isdisjoint(unit):
            text = unit.decode()
            if not text.isascii() and _PLAIN.fullmatch(text):
                return self._merge(text.lower().encode())
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self._merge(unit.lower())

    def _merge(self, unit: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(unit.decode("latin-1").translate(_CHARACTERS))]

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        lists = [self._ids(unit) for unit in units]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter((i for own in lists for i in own), np.int32, int(sizes.sum()))
        number = len(self.begin) - 1 + np.arange(len(hashes))
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, new])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.where = np.insert(self.where, at, number)

    def _missing(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, hashes)
        at[at == len(self.known)] = 0
        return self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin."""
        units = words_of(texts, self.table, _split_units)
        distinct, one, back = np.unique(units.hashes, return_index=True, return_inverse=True)
        missing = self._missing(distinct)
        if len(self.known) + missing.sum() > REMEMBERED_UNITS:
            self._forget()
            missing[:] = True
        if missing.any():
            self._learn(distinct[missing], units.texts(one[missing]))
        number = self.where[np.searchsorted(self.known, distinct)] if len(distinct) else back
        begin, size = self.begin[number][back], np.diff(self.begin)[number][back]
        total = np.concatenate([[0], np.cumsum(size)])
        index = np.arange(total[-1]) + np.repeat(begin - total[:-1], size)
        return self.ids[index], total[units.first]


def tokenise_pieces(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1
) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, start, length, ids, ids_crc32, doc_tokens, and
    the task and place in it where the piece arose, which makes ranks countable without a sort.

    A document's ids end with ``end_id``. Full pieces are cut from its front; the rest is one
    shorter piece.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.list_(pa.int32())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        known = worker_memory("tokenisers")
        if vocabulary not in known:
            known[vocabulary] = WordIds(vocabulary)
        encode = known[vocabulary]
        place = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text"):
            ids, first = encode(batch.column(1))
            docs_ids = np.insert(ids, first[1:], end_id)
            size = np.diff(first) + 1
            border = np.concatenate([[0], np.cumsum(size)])
            count = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), count)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = nth * capacity
            length = np.minimum(capacity, size[doc] - start)
            begin = border[doc] + start
            raw = docs_ids.astype("<i4")
            crc = [zlib.crc32(raw[a : a + n]) for a, n in zip(begin, length)]
            order = np.argsort(length, kind="stable")
            sorted_length = length[order]
            new = np.searchsorted(sorted_length, sorted_length)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - new + place[sorted_length]
            place += np.bincount(length, minlength=capacity + 1)
            # Pieces lie one after the other, so their borders are the list offsets.
            edges = np.concatenate([begin, [border[-1]]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(raw))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(start),
                    pa.array(length.astype(np.int32)),
                    lists.cast(kind),
                    pa.array(crc, pa.int64()),
                    pa.array(size[doc]),
                    pa.array(np.full(len(doc), task, np.int32)),
                    pa.array(rank),
                ],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(cut, PIECES)


@dataclass
class Pattern:
    """A multiset of lengths, how many sequences are filled with it, and the first of them."""

    lengths: dict[int, int]
    times: int
    first: int


def _best_fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of at most ``counts`` lengths that comes closest to ``space``.

    Bit s of a Python integer says that the sum s can be reached. A length with c copies enters as
    1, 2, 4, ... copies and a rest, so each step is one shift; the sums after every step are kept for
    the way back, which yields how many copies of each length were used.
    """
    mask = (1 << (space + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], space // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & mask
            if reach >> space & 1:
                break
            left -= part
            part *= 2
        if reach >> space & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def fill_patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Minimum bin slack over a histogram: the longest length left is set, the remaining space is
    filled as closely as can be, and the pattern is repeated as often as the counts allow.

    Every pattern uses up the spare copies of at least one length, so the work is bounded by the
    capacity alone, whatever the counts.
    """
    counts = {n: c for n, c in histogram.items() if c > 0}
    patterns, first = [], 0
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        used = _best_fill({n: c for n, c in rest.items() if c}, capacity - longest)
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in used.items())
        patterns.append(Pattern(used, times, first))
        first += times
        for n, k in used.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return patterns


def _places(patterns: list[Pattern]) -> list[tuple]:
    """(length, from rank, to rank, copies, first sequence, offset): where ranks of a length go."""
    done: dict[int, int] = {}
    rows = []
    for p in patterns:
        offset = 0
        for n in sorted(p.lengths, reverse=True):
            copies = p.lengths[n]
            begin = done.get(n, 0)
            done[n] = begin + copies * p.times
            rows.append((n, begin, done[n], copies, p.first, offset))
            offset += n * copies
    return rows


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 1
) -> DataFrame:
    """Documents as token ids, packed into sequences of at most ``capacity``.

    ``docs``: doc_id, text. Result, one row per piece: doc_id, start (ids of the document before
    it), length, ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id (from 0, without gaps), offset (from 0 within the sequence, without gaps).

    Three steps. Tokenising tasks store the pieces with their rank among the pieces of equal length
    in that task. The driver gets the histogram, at most ``capacity`` counts, and plans patterns
    from it. A piece's rank within its length, which is the task's offset plus the rank in the
    task, then says by arithmetic which sequence it goes to: no sort, and pieces are not moved
    between tasks, however many have the same length.

    A null or empty text is the end id alone. Texts are tokenised whole, in batches that hold one
    long text at most. Repeated rows and ids are packed as often as they come. Other columns are
    ignored. No documents, no rows. The stored pieces survive lost executors.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    tokenise_pieces(docs, vocabulary, capacity, end_id).write.parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()
    patterns = fill_patterns({row["length"]: row["n"] for row in counts}, capacity)
    places = spark.createDataFrame(
        _places(patterns),
        "length int, low long, high long, copies int, first_sequence long, first_offset int",
    )
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select(
        "length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    ranked = pieces.join(offsets, ["length", "task"]).withColumn(
        "rank", F.col("base") + F.col("place")
    )
    # Bounded: the places are a function of the histogram, some ten thousand rows at most.
    spots = F.broadcast(places.withColumnRenamed("length", "n"))
    inside = (F.col("length") == F.col("n")) & F.col("rank").between(F.col("low"), F.col("high") - 1)
    nth = F.col("rank") - F.col("low")
    return ranked.join(spots, inside).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(nth / F.col("copies"))).alias("sequence_id"),
        (F.col("first_offset") + F.col("length") * (nth % F.col("copies"))).alias("offset"),
    )
