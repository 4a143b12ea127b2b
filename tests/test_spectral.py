"""Weights and eigenvectors of a neighbour graph against dense versions."""

import math

import numpy as np
import pytest

from reviewlens.operators.neighbours import knn_graph
from reviewlens.operators.spectral import eigenvectors, fuzzy_weights, local_scales, spectral_layout


def plain_weights(graph):
    """(id, neighbour) -> symmetric weight, row by row."""
    lists = {}
    for i, _, j, sim in sorted(graph):
        lists.setdefault(i, []).append((j, max(0.0, 1 - sim)))
    own = {}
    for i, links in lists.items():
        nearest = min((d for _, d in links if d > 0), default=0.0)
        low, high = 1e-12, 1e6
        for _ in range(200):
            mid = math.sqrt(low * high)
            total = sum(math.exp(-max(0, d - nearest) / mid) for _, d in links)
            low, high = (low, mid) if total > math.log2(max(len(links), 2)) else (mid, high)
        scale = max(low, 1e-3 * sum(d for _, d in links) / len(links), 1e-12)
        for j, d in links:
            own[i, j] = math.exp(-max(0, d - nearest) / scale)
    return {
        (i, j): own.get((i, j), 0) + own.get((j, i), 0) - own.get((i, j), 0) * own.get((j, i), 0)
        for a, b in own
        for i, j in ((a, b), (b, a))
    }


def rows_of(seed, count, width):
    draw = np.random.default_rng(seed)
    turn = draw.uniform(0, 2.5, count)
    line = np.stack([np.cos(turn), np.sin(turn), 0.3 * turn], axis=1)
    return np.concatenate([line, np.zeros((count, width - 3))], axis=1) + 0.08 * draw.normal(size=(count, width))


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(f"p{n:03d}", v.tolist()) for n, v in enumerate(rows_of(1, 160, 6))]
    table = spark.createDataFrame(rows, "id string, embedding array<double>")
    return spark.createDataFrame(knn_graph(table, k=8).collect(), "id string, rank int, neighbour string, sim double")


def test_scales_give_the_wanted_sum():
    draw = np.random.default_rng(2)
    distances = np.sort(draw.gamma(1, 1, (50, 12)), axis=1)
    distances[3, :4] = 0
    mask = np.arange(12) < draw.integers(4, 13, 50)[:, None]
    nearest, scale = local_scales(distances, mask, 12)
    total = np.where(mask, np.exp(-np.maximum(distances - nearest[:, None], 0) / scale[:, None]), 0).sum(axis=1)
    # Weights of 1 alone exceed the sum where five are no farther than the nearest.
    reachable = (mask.sum(axis=1) > math.log2(12)) & (np.arange(50) != 3)
    assert np.allclose(total[reachable], math.log2(12), atol=1e-6)
    assert np.isfinite(scale).all() and nearest[3] == distances[3][distances[3] > 0].min()


def test_weights_equal_the_plain_ones(spark, graph):
    found = {(r.id, r.neighbour): r.weight for r in fuzzy_weights(graph).collect()}
    expected = plain_weights([tuple(r) for r in graph.collect()])
    assert set(found) == set(expected)
    assert max(abs(found[key] - expected[key]) for key in found) < 1e-6
    assert all(found[i, j] == pytest.approx(found[j, i], abs=1e-15) for i, j in found)


def dense(weights):
    names = sorted({i for i, _ in weights})
    at = {name: n for n, name in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for (i, j), w in weights.items():
        matrix[at[i], at[j]] = w
    root = np.sqrt(matrix.sum(axis=1))
    values, vectors = np.linalg.eigh(matrix / np.outer(root, root))
    return names, values[::-1], vectors[:, ::-1]


def test_eigenvectors_equal_a_dense_solver(spark, graph):
    weights = fuzzy_weights(graph)
    names, values, vectors = dense({(r.id, r.neighbour): r.weight for r in weights.collect()})
    assert values[0] == pytest.approx(1) and values[1] < 0.9999
    found = eigenvectors(weights, count=4)
    assert found.rounds < 40 and max(found.residuals) <= 1e-6
    assert np.allclose(found.values, values[:4], atol=1e-9)
    rows = {r.id: [r[f"e{c}"] for c in range(4)] for r in found.vectors.collect()}
    own = np.array([rows[name] for name in names])
    for c in range(4):
        assert abs(own[:, c] @ vectors[:, c]) == pytest.approx(1, abs=1e-8)
    assert np.allclose(own.T @ own, np.eye(4), atol=1e-8)


def test_layout(spark, graph):
    weights = fuzzy_weights(graph)
    rows = spectral_layout(weights).collect()
    first = np.array([[r.dim1, r.dim2] for r in rows])
    assert len(rows) == 160
    assert np.allclose((first**2).mean(axis=0), 1, atol=1e-8)
    assert ((first**3).sum(axis=0) >= 0).all()


def test_small_and_broken_graphs(spark):
    schema = "id string, rank int, neighbour string, sim double"
    none = spark.createDataFrame([], schema)
    assert fuzzy_weights(none).count() == 0
    assert spectral_layout(fuzzy_weights(none)).count() == 0
    pair = spark.createDataFrame([("a", 1, "b", 0.5), ("b", 1, "a", 0.5)], schema)
    rows = {r.id: r for r in spectral_layout(fuzzy_weights(pair)).collect()}
    assert set(rows) == {"a", "b"}
    assert rows["a"].dim1 == pytest.approx(-rows["b"].dim1) and rows["a"].dim2 is None
    # Equal vectors are at no distance; two components share the value 1.
    two = [("a", 1, "b", 1.0), ("b", 1, "a", 1.0), ("c", 1, "d", 0.2), ("d", 1, "c", 0.2)]
    found = eigenvectors(fuzzy_weights(spark.createDataFrame(two, schema)), count=2)
    assert np.allclose(found.values, [1, 1])
