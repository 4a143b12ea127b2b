"""Token ids in binary segments, with Elias-Fano encoded document boundaries.

A segment is one file: some documents' ids one after the other, at two or four bytes each, and two
Elias-Fano sequences, the place where each document begins and the documents' own ids. It is written
and read by Spark's file sources alone, so it may lie in any store that Spark reaches.

Layout, little-endian: ``MAGIC``; eight signed 64-bit numbers, ``HEADER``; both sequences; the ids.
An Elias-Fano sequence: three 64-bit numbers (values, low bits each, bytes of the high part), the
number of ones before each 512 bits of the high part (32 bits each), the high part, the low bits.
Whatever follows the ids, such as the line end of the text writer, is no part of a segment.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.packing import _CHARACTERS as BYTE_CHARACTERS
from reviewlens.llm.text import bounded_batches, slices, whole_text, worker_memory
from reviewlens.storage import scratch_path

MAGIC = b"EFTOKEN1"
HEADER = ("part", "segment", "documents", "nulls", "first_id", "ids", "id_bytes", "index_bytes")
# A segment ends with the document that brings it to this number of ids.
SEGMENT_IDS = 1 << 22
# Pieces whose ids a Python worker remembers, at about 200 bytes each, and their longest.
REMEMBERED = 1_000_000
LONGEST = 48
# Characters of a text that are cut into units at a time.
STRETCH = 1 << 20
# Bits of the high part between two stored counts of ones.
BLOCK_BITS = 512

# The characters that the byte-level splitter takes for white space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F]
_SPACE = "".join(map(chr, [*_SPACES, 0x205F, 0x3000]))
_UNIT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_BORDER = re.compile(f"[^{_SPACE}](?=[{_SPACE}])")
# ASCII and the letters from U+00C0 to U+00FF, and how the splitter cuts texts of nothing else.
_LETTERS = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0xFF)))
_PLAIN = re.compile(f"[\\x00-\\x7f{_LETTERS}]*")
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\\t-\\r {_LETTERS}0-9]+"
    "|[\\t-\\r ]+(?![^\\t-\\r ])|[\\t-\\r ]+"
)

ROWS = (
    "part long, segment long, place long, doc_id long, local_start long, n_tokens long, "
    "ids_crc32 long"
)


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of unsigned 64-bit numbers, at about 2 + log2(top / count) bits each.

    The lowest ``low_bits`` of every number lie side by side; what is above them is coded in unary:
    the i-th one of ``high`` stands at (number >> low_bits) + i. ``ranks`` counts the ones before
    each block of ``high``, which makes the i-th one a search and a look into one block.
    """

    count: int
    low_bits: int
    high: np.ndarray
    ranks: np.ndarray
    low: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        count = len(values)
        top = int(values[-1]) if count else 0
        low_bits = max(0, (top // count).bit_length() - 1) if count else 0
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        bits = np.zeros(int(ones[-1]) + 1 if count else 0, bool)
        bits[ones] = True
        high = np.packbits(bits, bitorder="little")
        edges = np.arange(0, len(bits), BLOCK_BITS)
        ranks = np.searchsorted(ones, edges).astype("<u4")
        places = np.arange(low_bits, dtype=np.uint64)
        low = [np.zeros(0, np.uint8)]
        for at in range(0, count if low_bits else 0, STRETCH // 8):
            part = (values[at : at + STRETCH // 8, None] >> places) & np.uint64(1)
            low.append(np.packbits(part.astype(bool).ravel(), bitorder="little"))
        return cls(count, low_bits, high, ranks, np.concatenate(low))

    def to_bytes(self) -> bytes:
        head = np.array([self.count, self.low_bits, len(self.high)], "<i8")
        return b"".join(part.tobytes() for part in (head, self.ranks, self.high, self.low))

    @classmethod
    def from_bytes(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The sequence at the front of ``data``, and how many bytes it takes."""
        count, low_bits, size = (int(n) for n in np.frombuffer(data, "<i8", 3))
        blocks = -(-size * 8 // BLOCK_BITS)
        ranks = np.frombuffer(data, "<u4", blocks, 24)
        at = 24 + 4 * blocks
        high = np.frombuffer(data, np.uint8, size, at)
        at += size
        low = np.frombuffer(data, np.uint8, -(-count * low_bits // 8), at)
        return cls(count, low_bits, high, ranks, low), at + len(low)

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at some places of the sequence."""
        parts = [self._select(index[at : at + 4096]) for at in range(0, len(index), 4096)]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def _select(self, index: np.ndarray) -> np.ndarray:
        block = np.searchsorted(self.ranks, index, "right") - 1
        width = BLOCK_BITS // 8
        at = block[:, None] * width + np.arange(width)
        inside = at < len(self.high)
        raw = np.where(inside, self.high[np.where(inside, at, 0)], 0).astype(np.uint8)
        seen = np.cumsum(np.unpackbits(raw, axis=1, bitorder="little"), axis=1, dtype=np.int16)
        wanted = index - self.ranks[block].astype(np.int64) + 1
        ones = block * BLOCK_BITS + (seen >= wanted[:, None]).argmax(axis=1)
        values = (ones - index).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bit = index[:, None] * self.low_bits + np.arange(self.low_bits)
            own = (self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & np.uint8(1)
            places = np.arange(self.low_bits, dtype=np.uint64)
            values |= (own.astype(np.uint64) << places).sum(axis=1, dtype=np.uint64)
        return values


class Remembered(dict):
    """The ids of short strings, worked out when first met; forgets all when there are too many."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, text: str) -> bytes:
        ids = self.ids_of(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


class ByteIds:
    """Ids of texts as little-endian bytes; what returns in many texts is tokenised once.

    The splitter of byte-level vocabularies cuts a text of ASCII and plain accented letters into
    the matches of ``_PIECE``, whose ids do not depend on what surrounds them. Any other text is
    first cut where white space follows something else: the splitter never joins the two, and how
    it cuts white space depends on that run and the character behind it alone. For any other kind
    of tokeniser, or one with peculiar added tokens, the whole text is handed over.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        top = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.kind = id_type(top)
        self.code = "H" if self.kind == "<u2" else "I"
        split = self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [token.content for token in added]
        self.by_unit = (
            isinstance(split, pre_tokenizers.ByteLevel)
            and isinstance(self.model, models.BPE)
            and self.tokenizer.normalizer is None
            and split.use_regex
            and not split.add_prefix_space
            and not any(t.lstrip or t.rstrip or t.single_word for t in added)
            and not any(re.search(f"[{_SPACE}]", content) for content in self.added)
        )
        self.pieces = Remembered(self._merged)
        self.units = Remembered(self._unit)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, self.kind).tobytes()

    def _merged(self, piece: str) -> bytes:
        """The ids of what the splitter leaves together."""
        tokens = self.model.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARACTERS))
        ids = array(self.code, [token.id for token in tokens])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(t in text for t in self.added)

    def _unit(self, unit: str) -> bytes:
        if self._is_plain(unit):
            return b"".join(map(self.pieces.__getitem__, _PIECE.findall(unit)))
        return self._whole(unit)

    def __call__(self, text: str) -> bytes:
        if not self.by_unit:
            return self._whole(text)
        plain = self._is_plain(text)
        known, cut = (self.pieces, _PIECE) if plain else (self.units, _UNIT)
        parts, at = [], 0
        while at < len(text):
            border = _BORDER.search(text, at + STRETCH)
            to = border.end() if border else len(text)
            parts.extend(map(known.__getitem__, cut.findall(text, at, to)))
            at = to
        return b"".join(parts)


def id_type(top: int) -> str:
    """The narrowest of the two stored kinds that holds ids up to ``top``."""
    return "<u2" if top < 1 << 16 else "<u4"


def part_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """The doc_ids that end all parts but the last; an id that ends several fills the parts between.

    From a sketch of the ids alone: no text is read, and the driver gets one number per part.
    """
    shares = [F.lit((k + 1) / parts) for k in range(parts - 1)]
    ends = F.percentile_approx("doc_id", F.array(*shares), F.lit(100 * parts))
    row = docs.select(ends.alias("ends")).first() if shares else None
    return np.array((row and row["ends"]) or [], np.int64)


def tokenise(docs: DataFrame, vocabulary: str, end_id: int, bounds: np.ndarray) -> DataFrame:
    """part, doc_id, ids (bytes, with ``end_id`` at the end) and their width, a row per document.

    Documents of an id that ends several parts are dealt to them in turn.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = worker_memory("byte_ids")
        if vocabulary not in known:
            known[vocabulary] = ByteIds(vocabulary)
        ids_of = known[vocabulary]
        kind = "<u4" if end_id >= 1 << 16 else ids_of.kind
        end, turn = np.array([end_id], kind).tobytes(), 0
        for batch in slices(batches, "text"):
            ids = [ids_of(text) for text in batch.column(1).to_pylist()]
            if kind != ids_of.kind:
                ids = [np.frombuffer(raw, ids_of.kind).astype(kind).tobytes() for raw in ids]
            doc = batch.column(0)
            named = doc.is_valid().to_numpy(zero_copy_only=False)
            number = doc.fill_null(0).to_numpy()
            low = np.searchsorted(bounds, number, "left")
            room = np.searchsorted(bounds, number, "right") - low + 1
            part = np.where(named, low + (turn + np.arange(len(low))) % room, 0)
            turn += len(low)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()),
                    doc,
                    pa.array([raw + end for raw in ids], pa.binary()),
                    pa.array(np.full(len(ids), int(kind[2]), np.int32)),
                ],
                names=["part", "doc_id", "ids", "width"],
            )

    rows = docs.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(encode, "part int, doc_id long, ids binary, width int")


def segment_bytes(part: int, number: int, docs: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One segment of documents in ascending order of their ids, those without an id first."""
    nulls = sum(doc is None for doc in docs)
    known = np.array(docs[nulls:], np.int64)
    first = int(known[0]) if len(known) else 0
    sizes = np.array([len(raw) // width for raw in ids], np.int64)
    starts = EliasFano.of(np.concatenate([[0], np.cumsum(sizes)])).to_bytes()
    # Wrapping differences, so ids may lie as far apart as 64 bits allow.
    names = EliasFano.of(known.view(np.uint64) - np.uint64(first % (1 << 64))).to_bytes()
    head = [part, number, len(docs), nulls, first, int(sizes.sum()), width, len(starts) + len(names)]
    return b"".join([MAGIC, np.array(head, "<i8").tobytes(), starts, names, *ids])


@dataclass(frozen=True)
class Segment:
    """A segment's content: any document's ids are found without reading the others' places."""

    head: dict[str, int]
    starts: EliasFano
    names: EliasFano
    ids: np.ndarray

    @classmethod
    def read(cls, content: bytes) -> Segment:
        data = memoryview(content)
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("this is no segment of token ids")
        at = len(MAGIC) + 8 * len(HEADER)
        head = dict(zip(HEADER, np.frombuffer(data, "<i8", len(HEADER), len(MAGIC)).tolist()))
        starts, size = EliasFano.from_bytes(data[at:])
        names, _ = EliasFano.from_bytes(data[at + size :])
        kind = f"<u{head['id_bytes']}"
        ids = np.frombuffer(data, kind, head["ids"], at + head["index_bytes"])
        return cls(head, starts, names, ids)

    def doc_ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of the documents at some places behind those without an id."""
        offsets = self.names.select(places - self.head["nulls"])
        return (offsets + np.uint64(self.head["first_id"] % (1 << 64))).view(np.int64)

    def document(self, place: int) -> np.ndarray:
        """The token ids of one document, by two selects."""
        begin, end = self.starts.select(np.array([place, place + 1]))
        return self.ids[int(begin) : int(end)]


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    segment_ids: int = SEGMENT_IDS,
    parts: int | None = None,
) -> None:
    """All documents as token ids below ``path``, in ascending order of doc_id, in segment files.

    ``docs``: doc_id, text; other columns are ignored. Tasks tokenise where the texts are; the ids,
    not the texts, are dealt by ranges of doc_id into ``parts`` (the session's shuffle partitions)
    and sorted. A task holds one segment at a time: ``segment_ids`` ids and the last document's.
    A null or empty text is the end id alone. Repeated ids are written as often as they come, in a
    fixed order, and may fill several parts; documents without an id come first. No documents, no
    segments.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tokens = tokenise(docs, vocabulary, end_id, part_bounds(docs, parts))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, ids, size, width = [], [], 0, 2
        part, number = None, 0

        def segment() -> pa.RecordBatch:
            raw = pa.array([segment_bytes(part, number, docs, ids, width)], pa.binary())
            return pa.RecordBatch.from_arrays([raw], names=["segment"])

        for batch in batches:
            for own, doc, raw, width in zip(*(column.to_pylist() for column in batch.columns)):
                if docs and (own != part or size >= segment_ids):
                    yield segment()
                    docs, ids, size, number = [], [], 0, number + 1
                if own != part:
                    part, number = own, 0
                docs.append(doc)
                ids.append(raw)
                size += len(raw) // width
        if docs:
            yield segment()

    # Equal documents of one id have equal marks, and either may come first.
    marked = tokens.withColumn("mark", F.xxhash64("ids"))
    dealt = marked.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id", "mark")
    columns = dealt.select("part", "doc_id", "ids", "width")
    # The text writer puts the bytes down as they are; one row is one file.
    segments = columns.mapInArrow(write, "segment binary").select(
        F.col("segment").cast("string").alias("value")
    )
    segments.write.option("maxRecordsPerFile", 1).text(path)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """The documents of all segments, unordered, with their place within the segment (``ROWS``).

    Offsets come from selects on the boundaries; ids_crc32 is that of the ids as little-endian
    unsigned 32-bit numbers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = content.as_buffer()
                if raw is None or not raw.size:
                    continue
                own = Segment.read(memoryview(raw))
                count, nulls = own.head["documents"], own.head["nulls"]
                for at in range(0, count, 1 << 16):
                    place = np.arange(at, min(at + (1 << 16), count))
                    edges = own.starts.select(np.append(place, place[-1] + 1)).astype(np.int64)
                    ids = own.ids[edges[0] : edges[-1]].astype("<u4")
                    inner = edges - edges[0]
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(inner[:-1], inner[1:])]
                    missing = place < nulls
                    doc = np.zeros(len(place), np.int64)
                    doc[~missing] = own.doc_ids(place[~missing])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(place), own.head["part"])),
                            pa.array(np.full(len(place), own.head["segment"])),
                            pa.array(place),
                            pa.array(doc, mask=missing),
                            pa.array(edges[:-1]),
                            pa.array(np.diff(edges)),
                            pa.array(crc, pa.int64()),
                        ],
                        names=[f.split()[0] for f in ROWS.split(", ")],
                    )

    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(read, ROWS)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each written document.

    The files are read once; the rows found are stored, and the ids before a segment are summed up
    in two levels, over parts and within them.
    """
    stored = scratch_path(spark, "token-rows")
    read_segments(spark, path).write.parquet(stored)
    rows = spark.read.schema(ROWS).parquet(stored)
    sizes = rows.groupBy("part", "segment").agg(F.sum("n_tokens").alias("n"))
    # One row per part, of which there are as many as the writing shuffle had partitions.
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    bases = bases.join(parts, "part").select(
        "part", "segment", (F.col("ahead") + F.col("inner")).alias("base")
    )
    placed = rows.join(bases, ["part", "segment"])
    start = (F.col("base") + F.col("local_start")).alias("start")
    return placed.select("doc_id", start, "n_tokens", "ids_crc32")
