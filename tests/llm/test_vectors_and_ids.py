"""Token id segments, whitening and hard negatives, against plain versions of the same thing."""

import math
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from reviewlens.llm import binary, negatives
from reviewlens.llm.binary import ByteIds, EliasFano, Segment, read_tokens, segment_bytes, write_tokens
from reviewlens.llm.negatives import Lists, mine_negatives, search
from reviewlens.llm.queries import QUERIES, vocabulary
from reviewlens.llm.whitening import centred_rows, cross_products, square_sums, whiten
from reviewlens.storage import scratch_path

FOLDER = "/root/testdata/sf0.001"
BYTES = "byte_bpe_50k.json"


# Elias-Fano sequences and segments


@pytest.mark.parametrize("top", [0, 1, 7, 1000, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("count", [0, 1, 2, 511, 5000])
def test_sequences_come_back(top, count):
    rng = np.random.default_rng(count)
    values = np.sort(rng.integers(0, top, count, dtype=np.uint64, endpoint=True))
    data = memoryview(EliasFano.of(values).to_bytes() + b"more")
    found, size = EliasFano.from_bytes(data)
    assert size == len(data) - 4
    some = rng.permutation(count)
    assert (found.select(some) == values[some]).all()
    bits = 8 * size - 24 * 8
    # About two bits and the low bits for each number, and the counts of ones.
    assert bits <= count * (2.2 + max(0, math.log2((top + 1) / count))) * 1.07 + 120 if count else bits == 0


def test_a_segment_finds_each_document():
    ids = [b"", b"\x01\x00", b"\x02\x00\x03\x00", b"\x04\x00"]
    docs = [None, -(1 << 63), 5, (1 << 63) - 1]
    own = Segment.read(segment_bytes(3, 1, docs, ids, 2) + b"\n")
    assert (own.head["part"], own.head["segment"], own.head["nulls"]) == (3, 1, 1)
    assert own.doc_ids(np.array([1, 2, 3])).tolist() == docs[1:]
    assert [own.document(k).tolist() for k in range(4)] == [[], [1], [2, 3], [4]]
    with pytest.raises(ValueError):
        Segment.read(b"something else, long enough to hold a head")


def test_ids_by_unit_are_those_of_the_whole_text():
    path = vocabulary(BYTES)
    whole, units = Tokenizer.from_file(path), ByteIds(path)
    assert units.by_unit
    rng = random.Random(5)
    pieces = [
        *"aZ09'.-_ \t\n\r\x0b\x0c\x1c\x85", chr(0xA0), chr(0x2003), chr(0x3000), chr(0x200B), chr(0x180E),
        "the", "'s", "'ll", "été", "Ü×÷ª", "²", "_", "\x00", "한국", "<|endoftext|>", "🙂", "\n\n", "  ", "1234",
    ]
    for _ in range(6000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        expected = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(units(text), units.kind).tolist() == expected, repr(text)


def test_long_texts_are_cut_where_units_end(monkeypatch):
    monkeypatch.setattr(binary, "STRETCH", 50)
    path = vocabulary(BYTES)
    whole = Tokenizer.from_file(path)
    for mark in ("", chr(0x2014)):
        text = f"some words  here{mark}\n\nand there, " * 40 + "x" * 300
        expected = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ByteIds(path)(text), "<u2").tolist() == expected


def plain_rows(pairs):
    """What is to be read back, from (doc_id, text) in the order they were written."""
    tokenizer = Tokenizer.from_file(vocabulary(BYTES))
    rows, start = [], 0
    for doc, text in pairs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        rows.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return rows


def test_binary_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    expected = plain_rows(sorted((r.doc_id, r.text) for r in docs))
    found = QUERIES["op11_binary_output"](spark, FOLDER)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("segment_ids", [1, 7, 1 << 22])
def test_segments_of_any_size(spark, docs_of, segment_ids):
    rows = {-5: "first", 0: None, 1: "", 2: "a  b\n", 900: "long " * 3000, 1 << 62: "last"}
    path = scratch_path(spark, "test-segments")
    write_tokens(docs_of(rows), path, vocabulary(BYTES), segment_ids=segment_ids)
    assert sorted(map(tuple, read_tokens(spark, path).collect())) == plain_rows(sorted(rows.items()))


def test_repeated_and_missing_ids(spark, docs_of):
    rows = [(None, "b"), (None, "a"), (3, "x y"), (3, "x y"), (3, "z"), (1, "one")]
    path = scratch_path(spark, "test-segments")
    write_tokens(docs_of(rows), path, vocabulary(BYTES))
    found = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == [None, None, 1, 3, 3, 3]
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found[:-1]]).tolist()
    assert sorted((r[0] or -1, r[3]) for r in found) == sorted((r[0] or -1, r[3]) for r in plain_rows(rows))
    # An id with most of the documents fills several parts, in order all the same.
    rows = [(9, f"text {k % 3}") for k in range(60)] + [(k, "own") for k in range(20)]
    path = scratch_path(spark, "test-segments")
    write_tokens(docs_of(rows), path, vocabulary(BYTES), parts=7)
    found = sorted(map(tuple, read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in found] == sorted(r[0] for r in rows)
    assert [r[1] for r in found] == np.cumsum([0] + [r[2] for r in found[:-1]]).tolist()
    assert spark.read.format("binaryFile").load(path).where("length > 0").count() > 4
    empty = scratch_path(spark, "test-segments")
    write_tokens(docs_of([]), empty, vocabulary(BYTES))
    assert read_tokens(spark, empty).count() == 0


# Whitening


def test_squares_are_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 10, 1 << 30, 1 << 61):
        values = rng.integers(-top, top, (300, 5))
        assert square_sums(values) == [sum(int(v) ** 2 for v in column) for column in values.T]
    big = centred_rows(np.array([[1 << 60], [-(1 << 60)]]), 100, [0])
    assert square_sums(big) == [2 * (100 << 60) ** 2]


def test_polarisation_gives_all_covariances():
    rows = np.random.default_rng(2).integers(-50, 50, (40, 6))
    own = centred_rows(rows, 40, rows.sum(axis=0).tolist())
    squares = np.zeros((6, 6), object)
    for i in range(6):
        for j in range(i, 6):
            value = own[:, i] + own[:, j] if i != j else own[:, i]
            squares[i, j] = int((value * value).sum())
    assert (cross_products(squares).astype(np.int64) == own.T @ own).all()


def plain_whitening(vectors, components):
    """vec_id -> (deviation, whitened up to sign, explained), by a dense decomposition."""
    good = {
        k: [math.floor(256.0 * float(np.float32(c))) for c in v]
        for k, v in vectors.items()
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    }
    fit = np.array(sorted(set(map(tuple, good.values()))))
    n, sums = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T, bias=True)
    values, basis = np.linalg.eigh(covariance)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    out = {}
    for k, x in good.items():
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))
        out[k] = (n, deviation, (np.array(x) - sums / n) @ basis / np.sqrt(values), values / np.trace(covariance))
    return out


def check_whitening(rows, expected, components):
    assert len(rows) == components * len(expected)
    signs = {}
    for r in sorted(rows, key=lambda r: (r.component, -abs(r.whitened), r.vec_id)):
        n, deviation, white, explained = expected[r.vec_id]
        k = r.component - 1
        sign = signs.setdefault(k, math.copysign(1, r.whitened * white[k]))
        assert (r.n, int(r.deviation)) == (n, deviation)
        assert r.whitened == pytest.approx(sign * white[k], abs=1e-9)
        assert r.explained == pytest.approx(explained[k], rel=1e-9)
        assert 0 <= r.identity_error < 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()
    expected = plain_whitening({r.vec_id: r.embedding for r in rows}, 4)
    check_whitening(QUERIES["op12_embedding_whitening"](spark, FOLDER).collect(), expected, 4)


def vectors_of(spark, rows):
    """An embeddings table with columns whose names may clash."""
    return spark.createDataFrame(
        [(*r, 1, "a", 2) for r in rows],
        "vec_id long, label int, embedding array<float>, n long, x string, `row.s` int",
    )


def test_whitening_of_odd_rows(spark):
    nan = float("nan")
    rng = np.random.default_rng(3)
    usual = {k: [float(c) for c in rng.normal(size=3).astype(np.float32)] for k in range(40)}
    usual[41] = usual[7]
    odd = [(50, 1, None), (51, 1, [1.0, None, 2.0]), (52, 1, [nan, 1.0, 1.0]), (53, 1, [1.0, float("inf"), 0.0])]
    shapes = [(54, 1, []), (55, 1, [1.0])]
    frame = vectors_of(spark, [(k, None, v) for k, v in usual.items()] + odd + shapes)
    check_whitening(whiten(frame, components=2).collect(), plain_whitening(usual, 2), 2)


def test_whitening_without_variance_or_rows(spark):
    same = vectors_of(spark, [(k, 1, [0.5, -0.5]) for k in (1, 1, None)])
    rows = whiten(same).collect()
    assert len(rows) == 6 and {r.n for r in rows} == {1} and {int(r.deviation) for r in rows} == {0}
    assert all(r.whitened is None and r.explained == 0 and r.identity_error is None for r in rows)
    assert whiten(same.limit(0)).count() == 0
    line = vectors_of(spark, [(k, 1, [float(k), 2.0 * k]) for k in range(5)])
    rows = whiten(line).collect()
    assert {r.component for r in rows if r.whitened is None} == {2}
    assert all(r.identity_error < 1e-9 for r in rows)


# Hard negatives


def plain_negatives(rows, anchors, positives=5, count=3, low=50, high=95):
    """Every row against every other, for rows (vec_id, label, whole vector)."""
    out = []
    for own in rows:
        if not anchors(own[0]):
            continue
        scored = [(-sum(a * b for a, b in zip(own[2], r[2])), r[0], r[1]) for r in rows if r is not own]
        scored.sort()
        best = [(-s, i) for s, i, label in scored if label == own[1]][:positives]
        for score, positive in best:
            window = [
                (-s, i) for s, i, label in scored
                if label != own[1] and low * score <= -100 * s <= high * score
            ]
            for rank, (got, negative) in enumerate(window[:count], 1):
                out.append((own[0], positive, rank, negative, score, got))
    return sorted(out)


def whole(vector):
    return [math.floor(256.0 * float(np.float32(c))) for c in vector]


@pytest.mark.parametrize("block,bundle", [(8192, 512), (16, 3)])
def test_negatives_equal_all_pairs(spark, monkeypatch, block, bundle):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "BUNDLE_ROWS", bundle)
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(3)), (rng.integers(-2, 3, 4) / 4).tolist()) for k in range(150)]
    # One label holds a third of the rows, one vector stands many times, and one is all nought.
    rows += [(200 + k, 7, [0.5, 0.25, 0.0, 0.0]) for k in range(60)]
    rows += [(300 + k, 7, (rng.integers(-2, 3, 4) / 4).tolist()) for k in range(40)]
    rows += [(400, 0, [0.0] * 4)]
    found = mine_negatives(vectors_of(spark, rows), is_anchor=negatives.F.col("vec_id") % 5 == 0)
    expected = plain_negatives([(i, l, whole(v)) for i, l, v in rows], lambda i: i % 5 == 0)
    assert len(expected) > 100
    assert sorted(map(tuple, found.collect())) == expected


def test_negatives_of_odd_rows(spark):
    nan = float("nan")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.75, 0.0]), (3, 2, [0.75, 1.0]), (4, 2, [0.25, 0.0])]
    odd = [
        (10, None, [1.0, 0.0]), (None, 1, [1.0, 0.0]), (12, 2, None), (13, 2, [0.75, None]),
        (14, 2, [0.75, nan]), (15, 2, [0.75, 0.0, 0.0]), (16, 2, []), (2, 2, [0.75, 0.0]),
    ]
    frame = vectors_of(spark, good + odd)
    found = sorted(map(tuple, mine_negatives(frame, is_anchor=negatives.F.col("vec_id") == 0).collect()))
    assert found == plain_negatives([(i, l, whole(v)) for i, l, v in good], lambda i: i == 0)
    assert [r[3] for r in found] == [2, 3]
    assert mine_negatives(frame.limit(0)).count() == 0
    # Two rows of one id are two anchors, and each other's positives.
    twice = vectors_of(spark, [(5, 1, [1.0]), (5, 1, [0.5]), (6, 2, [0.5])])
    found = sorted(map(tuple, mine_negatives(twice, is_anchor=negatives.F.col("vec_id") == 5).collect()))
    assert found == [(5, 5, 1, 6, 32768, 16384)]
    wide = sorted(map(tuple, mine_negatives(twice, negatives.F.col("vec_id") == 5, high=100).collect()))
    assert wide == [(5, 5, 1, 6, 32768, 16384), (5, 5, 1, 6, 32768, 32768)]


def test_the_threshold_ends_the_search():
    rng = np.random.default_rng(6)
    rows = rng.integers(-256, 256, (5000, 3))
    lists = Lists(rows, np.arange(5000))
    read = []
    take = negatives.Wanted.take

    def counted(self, scores, new, *rest):
        read.append(len(new))
        take(self, scores, new, *rest)

    negatives.Wanted.take = counted
    try:
        anchor = np.array([200, -50, 3])
        (own,) = search(lists, anchor, [(-(1 << 62), 1 << 62)], 5, np.zeros(5000, bool))
    finally:
        negatives.Wanted.take = take
    scores = rows @ anchor
    assert own.rows.tolist() == sorted(range(5000), key=lambda r: (-scores[r], r))[:5]
    assert sum(read) < 2500
