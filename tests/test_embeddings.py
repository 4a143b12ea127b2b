import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reviewlens.operators import embeddings as emb
from reviewlens.operators import filters, projection
from reviewlens.operators.neighbours import knn_graph

SCHEMA = "id string, embedding array<float>"


def frame(spark, vectors):
    rows = [(key, [float(x) for x in vector]) for key, vector in vectors.items()]
    return spark.createDataFrame(rows, SCHEMA)


def test_zero_vector_is_null_and_never_ranked(spark):
    df = emb.l2_normalize(frame(spark, {"z": [0, 0], "a": [3, 4], "b": [-1, 0]}))
    rows = {r.id: r.embedding for r in df.collect()}
    assert rows["z"] is None and rows["a"] == pytest.approx([0.6, 0.8])
    closest = emb.closest_to_centroid(df, F.col("id").isin("a", "z"), 5).collect()
    assert [r.id for r in closest] == ["a", "b"]
    assert closest[0].sim == pytest.approx(1.0)


def test_empty_selection_has_no_representatives(spark):
    df = emb.l2_normalize(frame(spark, {"a": [3, 4]}))
    assert emb.closest_to_centroid(df, F.lit(False)).count() == 0
    assert emb.centroid(df.limit(0)).count() == 0


def test_closest_ignores_the_scale_of_the_input(spark):
    random = np.random.default_rng(1)
    vectors = {str(i): random.normal(size=8) for i in range(40)}
    scaled = {key: vector * (1 + int(key)) for key, vector in vectors.items()}
    chosen = F.col("id") < "2"
    a, b = (
        emb.closest_to_centroid(emb.l2_normalize(frame(spark, v)), chosen, 7).collect()
        for v in (vectors, scaled)
    )
    assert [r.id for r in a] == [r.id for r in b]


def test_first_embedding_of_an_id_is_used(spark):
    reviews = spark.createDataFrame([("1", 5.0), ("2", 6.0)], "id string, rating double")
    stored = spark.createDataFrame(
        [("1", 2, [0.0, 1.0]), ("1", 1, [1.0, 0.0]), ("3", 3, [1.0, 0.0])],
        "id string, pos int, embedding array<float>",
    )
    rows = emb.load_embeddings(reviews, stored, position="pos").collect()
    assert [(r.id, r.rating, r.embedding) for r in rows] == [("1", 5.0, [1.0, 0.0])]


def test_embedder_sees_batches_in_order(spark):
    def make():
        def embed(texts):
            assert len(texts) <= 32
            return [[float(len(text)), float(len(texts))] for text in texts]

        return embed

    texts = spark.range(70).coalesce(1).selectExpr("string(id) id", "repeat('x', int(id)) text")
    rows = {int(r.id): r.embedding for r in emb.embed_texts(texts, make).collect()}
    assert all(rows[i][0] == i for i in range(70))
    assert [rows[i][1] for i in (0, 40, 69)] == [32, 32, 6]
    with pytest.raises(PySparkException, match="another number of vectors"):
        emb.embed_texts(texts, lambda: lambda batch: [[1.0]]).collect()


def test_hashed_words_have_length_one(spark):
    texts = spark.createDataFrame([("1", "a b b"), ("2", "b a B")], "id string, text string")
    one, two = [r.embedding for r in emb.embed_texts(texts).orderBy("id").collect()]
    assert one == two and np.linalg.norm(one) == pytest.approx(1.0)


def test_half_precision(spark):
    values = np.array([0.1, -1 / 3, 6e-8, 1e-5, 65504.0, 0.0], dtype=np.float32)
    df = spark.createDataFrame([("1", values.tolist()), ("2", None), ("3", [])], SCHEMA)
    halves = df.select("id", emb.quantize_f16(F.col("embedding")).alias("h")).orderBy("id")
    rows = [r.h for r in halves.collect()]
    assert rows[0] == values.astype(np.float16).astype(np.float32).tolist()
    assert rows[1] is None and rows[2] == []


def test_sink_checks_every_vector(spark, tmp_path):
    path = emb.write_embeddings(frame(spark, {"a": [0.1, 1]}), str(tmp_path / "e"), 2)
    stored = spark.read.parquet(path)
    assert dict(stored.dtypes) == {"id": "string", "embedding": "array<float>"}
    assert stored.first().embedding == [float(np.float16(0.1)), 1.0]
    for bad in ([1.0], None):
        df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", bad)], SCHEMA)
        with pytest.raises(PySparkException, match="bad embedding for id b"):
            emb.write_embeddings(df, str(tmp_path / "bad"), 2)


def test_representatives(spark):
    df = spark.createDataFrame(
        [
            ("1", "alpha", 8.0, "t" * 200, [1.0, 0.0], 0.1, 0.1),
            ("2", "beta", 2.0, "short", [0.8, 0.6], 0.5, 0.5),
            ("3", "beta", None, "far", [0.0, 1.0], 5.0, 5.0),
        ],
        "id string, platform string, rating double, text string, embedding array<float>, "
        "dim1 double, dim2 double",
    )
    placed, reviews = df.select("id", "embedding", "dim1", "dim2"), df.drop("embedding")
    rows = emb.representatives(placed, reviews, filters.in_region(0, 0.5, 0, 0.2), 2).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("1", "alpha", 8.0, 1.0, "t" * 117 + "..."),
        ("2", "beta", 2.0, 0.8, "short"),
    ]
    region = filters.select_region(df, 0, 0.5, 0, 0.5)
    assert region.count() == 2
    summary = emb.region_summary(df).first()
    assert tuple(summary) == (3, 2.0, 3.5, 5.0, 5.0, 6.5, 8.0, 1)
    assert tuple(emb.region_summary(df.limit(0)).first())[0] == 0
    assert {r.platform: r.n for r in emb.platform_mix(df).collect()} == {"alpha": 1, "beta": 2}


def brute_force(vectors, k):
    keys = sorted(vectors)
    units = {key: np.array(v, dtype=np.float32).astype(float) for key, v in vectors.items()}
    units = {key: v / np.linalg.norm(v) for key, v in units.items() if np.any(v)}
    result = {}
    for key in units:
        others = [o for o in keys if o in units and o != key]
        result[key] = sorted((-round(float(units[key] @ units[o]), 9), o) for o in others)[:k]
    return result


def clustered(n, clusters=6, size=8, seed=3):
    random = np.random.default_rng(seed)
    centers = random.normal(size=(clusters, size)) * 3
    return {f"v{i:03}": centers[i % clusters] + random.normal(size=size) * 0.2 for i in range(n)}


@pytest.mark.parametrize("rows", [10, 40, 1000])
def test_neighbours_are_exact_with_copies_and_zeros(spark, rows):
    vectors = clustered(120)
    # A third of all rows are copies of one vector.
    vectors |= {f"w{i:03}": vectors["v007"] for i in range(60)}
    vectors["zero"] = np.zeros(8)
    found: dict = {}
    graph = knn_graph(frame(spark, vectors), k=4, block_rows=rows, visitor_rows=16)
    for row in graph.collect():
        found.setdefault(row.id, {})[row["rank"]] = (row.neighbour, row.sim)
    expected = brute_force(vectors, 4)
    assert set(found) == set(expected)
    for key, hits in expected.items():
        assert sorted(found[key]) == [1, 2, 3, 4]
        sims = [found[key][rank][1] for rank in (1, 2, 3, 4)]
        assert sims == pytest.approx([-sim for sim, _ in hits], abs=1e-9)
        assert [found[key][rank][0] for rank in (1, 2, 3, 4)] == [other for _, other in hits]


def test_neighbours_of_few(spark):
    assert knn_graph(frame(spark, {"a": [1, 0]}), k=3).count() == 0
    assert knn_graph(frame(spark, {"a": [0, 0]}), k=3).count() == 0
    pairs = knn_graph(frame(spark, {"a": [1, 0], "b": [0, 1]}), k=3).collect()
    assert sorted((r.id, r.neighbour) for r in pairs) == [("a", "b"), ("b", "a")]


def test_pca(spark):
    random = np.random.default_rng(0)
    matrix = random.normal(size=(60, 5)) * [5, 3, 1, 0.5, 0.1] + [10, -3, 2, 0, 1]
    matrix = matrix.astype(np.float32).astype(float)
    df = frame(spark, {f"{i:02}": row for i, row in enumerate(matrix)})
    result = projection.project_pca(df).orderBy("id").toPandas()[["dim1", "dim2"]].to_numpy()
    centred = matrix - matrix.mean(axis=0)
    loadings = np.linalg.svd(centred, full_matrices=False)[2][:2]
    loadings = [v * np.sign(v[np.abs(v).argmax()]) for v in loadings]
    assert result == pytest.approx(centred @ np.array(loadings).T, abs=1e-6)
    assert projection.project_pca(df.limit(0)).count() == 0


def test_cached_projection(spark, tmp_path):
    root = str(tmp_path / "cache")
    df = frame(spark, {str(i): v for i, v in enumerate(np.eye(4))})
    first = projection.cached_projection(df, root)
    assert first.count() == 4
    kept = tmp_path / "cache" / "projection_pca"
    stamps = [(p / "_SUCCESS").stat().st_mtime_ns for p in kept.iterdir()]
    assert projection.cached_projection(df.orderBy(F.desc("id")), root).count() == 4
    assert [(p / "_SUCCESS").stat().st_mtime_ns for p in kept.iterdir()] == stamps
    # Other rows, and as many other vectors, are projected anew.
    assert projection.cached_projection(df.where("id > 0"), root).count() == 3
    moved = frame(spark, {str(i): v * (i + 1) for i, v in enumerate(np.eye(4))})
    expected = sorted(map(tuple, projection.project_pca(moved).collect()))
    assert sorted(map(tuple, projection.cached_projection(moved, root).collect())) == expected
    assert len(list(kept.iterdir())) == 3
    assert projection.projection_path("r/", "pca", k=2) == "r/projection_pca_k2"
    with pytest.raises(ValueError):
        projection.projection_path(root, "umap")


def test_attach_projection(spark):
    reviews = spark.createDataFrame(
        [(p, str(i)) for p in ("b", "a") for i in range(50)], "platform string, key string"
    ).select(F.concat("platform", "key").alias("id"), "platform")
    placed = reviews.select("id", F.lit(0.5).alias("dim1"), F.lit(1.5).alias("dim2"))
    rows = projection.attach_projection(reviews, placed, with_index=True).collect()
    ordered = sorted(rows, key=lambda r: (r.platform, r.id))
    assert [r.idx for r in ordered] == list(range(1, 101))
    for bad in (placed.where("id <> 'a3'"), placed.unionByName(placed.limit(1)),
                placed.withColumn("id", F.when(F.col("id") == "a3", "z").otherwise(F.col("id")))):
        with pytest.raises(Exception, match="id"):
            projection.attach_projection(reviews, bad).collect()


def test_every_review_gets_one_vector(spark):
    reviews = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, n int")
    stored = spark.createDataFrame(
        [("a", [3.0, 0.0]), ("a", [0.0, 2.0]), ("b", [0.0, 1.0]), ("b", None)], "id string, embedding array<double>"
    )
    rows = {r.id: r.embedding for r in emb.load_embeddings(reviews, stored).collect()}
    assert rows == {"a": [0.0, 1.0], "b": [0.0, 1.0]}
    assert emb.load_embeddings(reviews, stored).count() == 2


def test_representatives_keep_ids_without_a_review_in_order(spark):
    placed = frame(spark, {"a": [1, 0], "b": [0.9, 0.1], "c": [0, 1]}).withColumns({"dim1": F.lit(0.0)})
    reviews = spark.createDataFrame([("b", "p", 5.0, "t"), ("a2", "p", 1.0, "u")], "id string, platform string, rating double, text string")
    rows = emb.representatives(emb.l2_normalize(placed), reviews, F.col("id") == "a", 3).collect()
    assert [(r.id, r.snippet) for r in rows] == [("a", None), ("b", "t"), ("c", None)]


def test_visits_of_the_neighbour_search(spark, capsys):
    """Separated groups visit few cells. No array holds more than one block or list of neighbours."""
    from reviewlens.operators import neighbours

    draw = np.random.default_rng(1)
    centres = np.eye(12)
    vectors = {f"{g:02}-{k}": centres[g] + draw.normal(size=12) * 0.01 for g in range(12) for k in range(40)}
    points = emb.l2_normalize(frame(spark, vectors).select(F.col("id").cast("string").alias("id"), "embedding"))
    distinct = neighbours._distinct_vectors(points, 3)
    pivots = neighbours._pivots(distinct)
    placed = neighbours._into_cells(distinct, pivots, 16).cache()
    radius = np.zeros(len(pivots))
    for row in placed.groupBy("cell").agg(F.max("away").alias("r")).collect():
        radius[row["cell"]] = row["r"]
    bounded = placed.withColumn("least", F.lit(0.99))
    later = neighbours._cells_to_visit(bounded, pivots, radius, 4).count()
    with capsys.disabled():
        print(f"\ncells {len(pivots)}, visited per vector after the first 4: {later / 480:.2f}")
    assert len(pivots) == 22 and later / 480 < 9


def test_a_vector_travels_once_to_a_region(spark, monkeypatch):
    """Without structure each vector meets nearly all others: before, it was sent to each block of each cell."""
    from reviewlens.operators import neighbours

    sent, across = spark.sparkContext.accumulator(0), neighbours._across

    def counted(*args):
        search = across(*args)

        def count(key, visitors, hosts):
            sent.add(visitors.num_rows)
            return search(key, visitors, hosts)

        return count

    monkeypatch.setattr(neighbours, "_across", counted)
    draw = np.random.default_rng(5)
    vectors = {f"{n:03}": draw.normal(size=24) for n in range(500)}
    found: dict = {}
    for row in knn_graph(frame(spark, vectors), k=3, block_rows=8, visitor_rows=50).collect():
        found.setdefault(row.id, {})[row["rank"]] = row.neighbour
    assert {key: [hits[n] for n in (1, 2, 3)] for key, hits in found.items()} == {
        key: [other for _, other in hits] for key, hits in brute_force(vectors, 3).items()
    }
    sides = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    # Twice, before and after the bound is set, to at most this many regions; there are 23 cells of three blocks or so.
    assert 0 < sent.value <= 2 * 500 * (sides + 1)


def test_neighbours_closer_than_single_precision_tells(spark):
    draw = np.random.default_rng(6)
    vectors = {f"{n:03}": np.ones(6) + draw.normal(size=6) * 3e-4 for n in range(90)}
    found: dict = {}
    for row in knn_graph(frame(spark, vectors), k=4, block_rows=16, visitor_rows=16).collect():
        found.setdefault(row.id, {})[row["rank"]] = row.sim
    # The reference's own values, which are not rounded to nine places here.
    units = {key: np.array(v, dtype=np.float32).astype(float) for key, v in vectors.items()}
    units = {key: v / np.linalg.norm(v) for key, v in units.items()}
    for key, hits in found.items():
        wanted = sorted((float(units[key] @ v) for other, v in units.items() if other != key), reverse=True)[:4]
        assert [hits[n] for n in (1, 2, 3, 4)] == pytest.approx(wanted, abs=1e-14)


@pytest.mark.parametrize("rows", [5, 40, 10_000])
def test_regions_hold_every_block_once(rows):
    from reviewlens.operators.neighbours import _regions

    draw = np.random.default_rng(7)
    sizes = draw.integers(0, 60, size=30)
    blocks = -(-sizes // 8)
    found = _regions(draw.normal(size=(30, 4)), sizes, blocks, rows)
    held: dict = {}
    for cell in range(30):
        for block in range(blocks[cell]):
            region = int(np.searchsorted(found.begin, found.first[cell] + block, "right")) - 1
            assert cell in found.cells[region]
            held[region] = held.get(region, 0) + sizes[cell] / blocks[cell]
    assert sorted(held) == list(range(len(found.cells))) and max(held.values()) < rows + 8
    assert len(held) <= -(-sizes.sum() // rows)
