"""Embeddings by the range finder, against a dense decomposition."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import semantic
from reviewlens.operators.semantic import semantic_embeddings

TOPICS = [[f"{name}{k}" for k in range(12)] for name in ("plot", "cast", "music", "scene")]
WIDE = "id string, text string"


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    rows = []
    for n in range(160):
        words = draw.choices(TOPICS[n % 4], k=draw.randint(4, 20)) + draw.choices(sum(TOPICS, []), k=3)
        # A third of the texts are equal, and one word is in all of them.
        rows.append((str(n), "the " + (" ".join(words) if n % 3 else "plot1 plot2 cast1")))
    return rows


def dense(rows):
    counts = {i: Counter((t or "").split()) for i, t in rows}
    ids = [i for i in counts if counts[i]]
    words = sorted({w for i in ids for w in counts[i]})
    spread = Counter(w for i in ids for w in counts[i])
    matrix = np.array([[counts[i][w] * (1 + math.log((1 + len(ids)) / (1 + spread[w]))) for w in words] for i in ids])
    return ids, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def test_values_and_vectors_equal_a_dense_decomposition(spark, texts):
    found = semantic_embeddings(spark.createDataFrame(texts, WIDE).repartition(5), dims=6)
    ids, matrix = dense(texts)
    left, values, _ = np.linalg.svd(matrix, full_matrices=False)
    error = np.abs(np.array(found.values) / values[:6] - 1)
    print(f"relative error of the singular values {error.max():.1e}")
    # The sixth lies among many of nearly its size, where the space is slow to turn.
    assert error[:5].max() < 1e-6 and error[5] < 2e-3
    got = {r.id: np.array(r.embedding) for r in found.vectors.collect()}
    assert set(got) == set(ids)
    ours = np.array([got[i] for i in ids])
    # The strong directions stand apart, so their vectors are fixed but for the sign.
    wanted = left[:, :4] * values[:4]
    wanted *= np.where((wanted**3).sum(axis=0) < 0, -1, 1)
    assert np.abs(ours[:, :4] - wanted).max() < 1e-3
    assert ((ours.astype(float) ** 3).sum(axis=0) > -1e-6).all()
    assert np.abs(got["0"] - got["3"]).max() < 1e-6


def test_texts_of_one_topic_are_closest(spark, texts):
    found = semantic_embeddings(spark.createDataFrame(texts, WIDE), dims=4, rounds=2)
    got = {r.id: np.array(r.embedding) for r in found.vectors.collect() if int(r.id) % 3}
    right = 0
    for own, vector in got.items():
        sims = {i: v @ vector / np.linalg.norm(v) for i, v in got.items() if i != own}
        right += int(max(sims, key=sims.get)) % 4 == int(own) % 4
    assert right / len(got) > 0.9


def test_nothing_little_and_repeated(spark):
    def run(rows, **how):
        found = semantic_embeddings(spark.createDataFrame(rows, WIDE), dims=3, extra=2, rounds=1, **how)
        return {r.id: [round(x, 4) for x in r.embedding] for r in found.vectors.collect()}, found.values

    assert run([]) == ({}, [])
    assert run([("a", None), ("b", ""), (None, "word")]) == ({"a": [0, 0, 0], "b": [0, 0, 0]}, [])
    vectors, values = run([("a", "x"), ("a", "x"), ("b", "x"), ("c", " - ")])
    assert vectors == {"a": [1, 0, 0], "b": [1, 0, 0], "c": [0, 0, 0]}
    assert values == pytest.approx([math.sqrt(2)])


def test_parts_exchange_only_words_of_several_parts(spark, texts, monkeypatch):
    """Ids that come twice and many small parts change nothing; no row of the exchange is a pair of text and word."""
    halves = [(i, t) for i, text in texts for t in (text, "own" + i) if t]
    table = spark.createDataFrame(halves, WIDE).repartition(7)
    joined = [(i, text + " own" + i) for i, text in texts]
    ids, matrix = dense(joined)
    left, values, _ = np.linalg.svd(matrix, full_matrices=False)
    rows = []
    sums = semantic._shared_sums

    def counted(*args):
        rows.append(sums(*args).count())
        return sums(*args)

    monkeypatch.setattr(semantic, "_shared_sums", counted)
    for found in (
        semantic.semantic_embeddings(table, dims=3, rounds=3),
        semantic.semantic_embeddings(spark.createDataFrame(joined, WIDE).coalesce(2), dims=3, rounds=3),
    ):
        got = {r.id: np.array(r.embedding) for r in found.vectors.collect()}
        assert set(got) == set(ids)
        assert np.abs(np.array(found.values) / values[:3] - 1).max() < 1e-5
        wanted = left[:, :3] * values[:3]
        wanted *= np.where((wanted**3).sum(axis=0) < 0, -1, 1)
        assert np.abs(np.array([got[i] for i in ids]) - wanted).max() < 1e-3
    # 49 words are in several texts; the last table has two parts, and 160 words are a text's own.
    assert rows[-1] == 2 * 49


def test_a_part_is_multiplied_in_runs_of_texts(monkeypatch):
    """A task holds the stored pairs and a run of them as numbers; before, four numbers for each pair."""
    monkeypatch.setattr(semantic, "SLICE_ENTRIES", 1 << 14)
    draw = np.random.default_rng(2)
    many = [["w0"] * 300 + [f"w{n}" for n in draw.integers(0, 3000, size=draw.integers(0, 600))] for _ in range(900)]
    lists = pa.array(many, pa.list_(pa.string()))
    counts = pa.nulls(len(many), pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(map(str, range(900))), lists, counts], names=["id", "words", "counts"])
    cuts = list(semantic._cuts(lists.value_lengths().to_numpy()))
    assert len(cuts) > 20 and [a for a, _ in cuts[1:]] == [b for _, b in cuts[:-1]] and not list(semantic._cuts(np.zeros(0, int)))
    row = pa.Table.from_batches([semantic._part(7, [semantic._entries(batch.slice(a, b - a)) for a, b in cuts])])
    words = row["words"][0].as_py()
    assert row["ids"][0].as_py() == [str(n) for n in range(900)]
    rarity = draw.uniform(1, 2, size=len(words))
    dense = np.array([[bag[w] for w in words] for bag in map(Counter, many)]) * rarity
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    tracemalloc.start()
    part = semantic._Part(row, rarity)
    left, right = draw.normal(size=(900, 3)), draw.normal(size=(3, len(words)))
    found = part.times(right), part.transposed(left)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(found[0] - dense @ right.T).max() < 1e-12 and np.abs(found[1] - left.T @ dense).max() < 1e-12
    assert peak < 8 * len(part.low)


def test_rows_of_many_megabytes_have_files_of_their_own(spark, texts, monkeypatch):
    """A writer or reader of Parquet holds all rows of a file that has few; each part is a row."""
    monkeypatch.setattr(semantic, "PART_ENTRIES", 300)
    monkeypatch.setattr(semantic, "SLICE_ENTRIES", 50)
    files, store = {}, semantic.stored

    def counted(df, name, *args):
        table = store(df, name, *args)
        files[name] = [r["count"] for r in table.groupBy(F.input_file_name()).count().collect()]
        return table

    monkeypatch.setattr(semantic, "stored", counted)
    found = semantic.semantic_embeddings(spark.createDataFrame(texts, WIDE).coalesce(1), dims=2, rounds=1)
    assert found.vectors.count() == 160
    assert len(files["parts"]) > 4 and set(files["parts"]) == set(files["matrix"]) == {1} and max(files["block"]) <= 4
