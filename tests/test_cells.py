"""Closest rows out of vectors stored by cell, against a scan of all of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import cells
from reviewlens.operators import embeddings as emb
from reviewlens.storage import scratch_path

WIDTH = 8
SCHEMA = "id string, platform string, embedding array<double>"


def groups(seed, rows=3000, centres=30, spread=0.08):
    """Vectors around some centres, a third of them equal, and some that are close to nothing."""
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(centres, WIDTH))
    out = []
    for k in range(rows):
        vector = middles[0] if k % 3 == 0 else middles[draw.integers(centres)] + spread * draw.normal(size=WIDTH)
        out.append((str(k), "ab"[k % 2], [float(x) for x in vector]))
    out += [("-1", "a", None), ("-2", "a", [0.0] * WIDTH), ("-4", "b", [1.0])]
    return out


@pytest.fixture(scope="module", params=["groups", "noise"])
def table(spark, request):
    rows = groups(1) if request.param == "groups" else groups(2, 1500, 1500, 1.0)
    df = emb.l2_normalize(spark.createDataFrame(rows, SCHEMA)).cache()
    path = scratch_path(spark, f"test-cells-{request.param}")
    cells.write_cells(df, path, parts=20)
    return request.param, df, path


def scan(df, chosen, k):
    usable = df.where(F.size("embedding") == WIDTH)
    return [(r.id, r.sim) for r in emb.closest_to_centroid(usable, chosen, k).collect()]


@pytest.mark.parametrize("k", [10, 1200])
def test_equals_the_scan_with_ties(spark, table, k):
    name, df, path = table
    # The second selection's closest rows are a thousand equal vectors, told apart by id.
    for chosen in ("id IN ('1', '2', '7')", "CAST(id AS INT) % 3 = 0"):
        usable = F.expr(chosen) & (F.size("embedding") == WIDTH)
        center = emb.centroid(df.where(usable)).first()["centroid"]
        found, report = cells.closest_in_cells(spark, path, center, k)
        got = [(r.id, r.sim) for r in found.collect()]
        assert got == scan(df, usable, k)
        assert found.columns == ["id", "platform", "sim"]
        assert report["first"] + report["later"] <= report["cells"]


def test_few_cells_are_read(spark, table):
    name, df, path = table
    read = []
    for row in df.where("CAST(id AS INT) % 400 = 1 AND CAST(id AS INT) % 3 <> 0").collect():
        _, report = cells.closest_in_cells(spark, path, row["embedding"], 5)
        read.append((report["first"] + report["later"]) / report["cells"])
    print(f"{name}: share of the cells read {sum(read) / len(read):.2f}")
    if name == "groups":
        assert sum(read) / len(read) < 0.25


def test_every_row_is_stored_once(spark, table):
    _, df, path = table
    rows = spark.read.parquet(f"{path}/vectors")
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in df.collect())
    assert {r.id for r in rows.where("cell = -1").collect()} == {"-1", "-2", "-4"}
    sizes = spark.read.parquet(f"{path}/cells").agg(F.sum("rows")).first()[0]
    assert sizes == rows.where("cell <> -1").count()


def test_a_third_of_equal_vectors_lies_in_several_files(spark, table):
    name, df, path = table
    if name == "groups":
        hot = df.where("id = '0'").first()["embedding"]
        same = spark.read.parquet(f"{path}/vectors").where(F.col("embedding") == F.array(*[F.lit(x) for x in hot]))
        assert same.select(F.col("_metadata.file_path")).distinct().count() >= 5


def test_files_and_row_groups_are_chosen(spark, table):
    name, _, path = table
    if name == "groups":
        one = spark.read.parquet(f"{path}/cells").orderBy("rows", "cell").first()
        found = cells.read_rings(spark, path, [(one["cell"], 0.0, math.pi)])
        assert len(found.inputFiles()) <= 2 and found.count() == one["rows"]
        text = found._jdf.queryExecution().executedPlan().toString()
        assert f"GreaterThanOrEqual(cell,{one['cell']})" in text


def test_nothing_stored_and_nothing_asked(spark):
    for name, rows in (("none", []), ("useless", [("a", "x", None), ("b", "x", [math.nan, 1.0])])):
        df = emb.l2_normalize(spark.createDataFrame(rows, SCHEMA))
        path = scratch_path(spark, f"test-cells-{name}")
        cells.write_cells(df, path)
        assert cells.closest_in_cells(spark, path, [1.0, 0.0], 3)[0].count() == 0
        assert spark.read.parquet(f"{path}/vectors").count() == len(rows)
        found, report = cells.closest_in_cells(spark, path, None, 3)
        assert found.count() == 0 and found.columns == ["id", "platform", "sim"] and report["cells"] == 0


def test_one_vector_and_a_column_called_ring(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0])], "id string, ring int, embedding array<double>")
    path = scratch_path(spark, "test-cells-one")
    cells.write_cells(df, path, cells=5)
    found, report = cells.closest_in_cells(spark, path, [0.6, 0.8], 5)
    assert [tuple(r) for r in found.collect()] == [("a", 1, 0.6)] * 2 and report["cells"] == 1


def test_runs_cover_the_numbers():
    draw = random.Random(3)
    for _ in range(50):
        numbers = draw.sample(range(300), draw.randint(1, 60))
        for most in (1, 3, 100):
            found = cells._runs(numbers, most)
            assert len(found) <= most and found == sorted(found)
            assert all(any(a <= n <= b for a, b in found) for n in numbers)
            if most == 100:
                covered = {n for a, b in found for n in range(a, b + 1)}
                assert covered == set(numbers)
