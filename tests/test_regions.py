"""Regions from the points stored by key, against a scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import regions
from reviewlens.operators.filters import select_region
from reviewlens.storage import scratch_path


def interleaved(x, y, bits):
    return sum(((x >> k & 1) << 2 * k) | ((y >> k & 1) << 2 * k + 1) for k in range(bits))


@pytest.fixture(scope="module")
def points(spark):
    draw = random.Random(1)
    rows = [(k, draw.gauss(0, 1), draw.gauss(0, 2)) for k in range(6000)]
    # A third of all points lie in one place.
    rows += [(10_000 + k, 0.25, 0.5) for k in range(3000)]
    rows += [(-1, None, 0.0), (-2, 0.0, math.nan), (-3, math.inf, 0.0), (-4, 0.0, -math.inf)]
    return spark.createDataFrame(rows, "id long, dim1 double, dim2 double").cache()


@pytest.fixture(scope="module")
def stored(spark, points):
    path = scratch_path(spark, "test-points")
    regions.write_points(points, path, parts=40)
    return path


def test_keys_interleave_the_cells(spark):
    draw = random.Random(2)
    rows = [(draw.uniform(-1, 3), draw.uniform(5, 6)) for _ in range(200)] + [(-1.0, 5.0), (3.0, 6.0)]
    table = spark.createDataFrame(rows, "x double, y double")
    for bits in (3, 24, 31):
        key = regions.point_key(F.col("x"), F.col("y"), (-1, 3), (5, 6), bits)
        for r in table.withColumn("key", key).collect():
            cells = regions.cell_number(r.x, (-1, 3), bits), regions.cell_number(r.y, (5, 6), bits)
            assert r.key == interleaved(*cells, bits)


@pytest.mark.parametrize("most", [1, 4, 16, 10_000])
def test_intervals_cover_the_rectangle(most):
    draw = random.Random(most)
    for _ in range(30):
        xs, ys = (tuple(sorted((draw.randrange(32), draw.randrange(32)))) for _ in range(2))
        found = regions.key_intervals(xs, ys, 5, most)
        wanted = {interleaved(x, y, 5) for x in range(xs[0], xs[1] + 1) for y in range(ys[0], ys[1] + 1)}
        covered = [k for low, high in found for k in range(low, high + 1)]
        assert len(covered) == len(set(covered)) and wanted <= set(covered)
        assert all(a[1] + 1 < b[0] for a, b in zip(found, found[1:]))
        if most == 10_000:
            assert set(covered) == wanted
    assert regions.key_intervals((3, 2), (0, 1), 5) == []


@pytest.mark.parametrize("region", [
    (-0.1, 0.1, -0.1, 0.1), (0.25, 0.25, 0.5, 0.5), (-9, 9, -9, 9), (-math.inf, math.inf, -math.inf, 0.0),
    (2, 1, 0, 1), (50, 60, 0, 1), (0.2, 0.3, -20, 20),
])
def test_equals_the_scan(spark, points, stored, region):
    found = regions.read_region(spark, stored, *region)
    assert found.columns == points.columns
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in select_region(points, *region).collect())


def test_few_files_are_read(spark, stored):
    every = spark.read.parquet(f"{stored}/files")
    count, rows = every.count(), every.agg(F.sum("rows")).first()[0]
    assert count == 40 and rows == 9004
    small, _ = regions.files_of_region(spark, stored, (-1.1, -0.9, 0.9, 1.1))
    read = small.agg(F.count("file"), F.sum("rows")).first()
    assert read[0] <= 6 and read[1] < rows / 5
    found = regions.read_region(spark, stored, -1.1, -0.9, 0.9, 1.1)
    assert len(found.inputFiles()) == read[0]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Or(And(Greater" in plan
    # The crowded place lies in several files.
    crowded, _ = regions.files_of_region(spark, stored, (0.25, 0.25, 0.5, 0.5))
    assert crowded.count() >= 10


def test_no_points(spark, points):
    for name, none in (("empty", points.limit(0)), ("nowhere", points.where("id = -1"))):
        path = scratch_path(spark, f"test-points-{name}")
        regions.write_points(none, path)
        assert regions.read_region(spark, path, -1, 1, -1, 1).count() == 0
