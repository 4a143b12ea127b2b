"""The split reader of quoted CSV files against Spark's multi-line reader."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.sources.quoted import file_lines, is_inside, read_quoted_csv, split_records, split_starts


def multi_line(spark, path):
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.option("encoding", "UTF-8").csv(str(path))


def written(folder, files):
    for name, text in files.items():
        (folder / name).write_bytes(text.encode())
    return str(folder)


def field(value, quote):
    return '"' + value.replace('"', '""') + '"' if quote or any(c in value for c in '",\n\r') else value


def table(draw, rows, end="\n"):
    pieces = ["a", "bc ", ",", '"', "\n", "\r\n", "\n\n", "é한", '""', "'", ", \"x", "long " * 20]
    lines = ["id,text,rating"]
    for k in range(rows):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 9)))
        lines.append(",".join([str(k), field(text, draw.random() < 0.3), field(str(k % 10), draw.random() < 0.2)]))
        if draw.random() < 0.05:
            lines.append("")
    return end.join(lines) + (end if draw.random() < 0.5 else "")


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes, each a task of its own."""
    old = {}
    for key, value in {"maxPartitionBytes": "257", "openCostInBytes": "1"}.items():
        old[key] = spark.conf.get(f"spark.sql.files.{key}")
        spark.conf.set(f"spark.sql.files.{key}", value)
    yield
    for key, value in old.items():
        spark.conf.set(f"spark.sql.files.{key}", value)


@pytest.mark.parametrize("line,outside,inside", [
    ("a,b", False, True), ('a,"b', True, False), ('a,"b"', False, False), ('a"b,c', False, False),
    ('a,"b""', True, False), ('a,b"', False, False), ('"', True, False), ('""', False, True), ('"""', True, False),
    ('x","y', True, True), ('x",y', False, False), ("", False, True), ('"a"b"c,"d', True, True),
])
def test_what_a_line_does(line, outside, inside):
    assert (is_inside(line, False), is_inside(line, True)) == (outside, inside)


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_equals_the_multi_line_reader(spark, small_splits, tmp_path, seed, end):
    draw = random.Random(seed)
    path = written(tmp_path, {f"{k}.csv": table(draw, 150, end) for k in range(3)})
    expected = sorted(map(tuple, multi_line(spark, path).collect()), key=repr)
    found = read_quoted_csv(spark, path)
    assert found.columns == ["id", "text", "rating"]
    rows = [tuple(r) for r in found.collect()]
    if end == "\r\n":
        # Where records end so, the multi-line reader shortens the same within quotes.
        assert any("\r\n" in (r[1] or "") for r in rows)
        rows = [(r[0], r[1] and r[1].replace("\r\n", "\n"), r[2]) for r in rows]
    assert sorted(rows, key=repr) == expected
    assert len(expected) == 450


def test_one_field_over_many_splits(spark, small_splits, tmp_path):
    text = "\n".join(f"line {k}, \"said\" it" for k in range(400))
    rows = ["id,text,n", f"1,{field(text, True)},2", "3,short,4", f"5,{field(text, True)},6"]
    path = written(tmp_path, {"a.csv": "\n".join(rows)})
    found = {r.id: (r.text, r.n) for r in read_quoted_csv(spark, path).collect()}
    assert found == {"1": (text, "2"), "3": ("short", "4"), "5": (text, "6")}


def test_quotes_within_plain_fields(spark, small_splits, tmp_path):
    rows = ["id,text", *(f'{k},5" wide {k}' for k in range(60)), '60,"broken\nline"', '61,say "hi" now']
    path = written(tmp_path, {"a.csv": "\n".join(rows) + "\n"})
    assert sorted(map(tuple, read_quoted_csv(spark, path).collect())) == sorted(map(tuple, multi_line(spark, path).collect()))


def test_headers(spark, tmp_path):
    files = {"a.csv": '﻿"i d","te\nxt","a.b"\r\n1,x,\r\n', "b.csv": '"i d","te\nxt","a.b"\r\n\r\n2,"",z'}
    path = written(tmp_path, files)
    found = read_quoted_csv(spark, path)
    assert found.columns == multi_line(spark, path).columns
    assert sorted(map(tuple, found.collect())) == [("1", "x", None), ("2", None, "z")]
    (tmp_path / "c").mkdir()
    only = written(tmp_path / "c", {"a.csv": "id,text\n"})
    assert read_quoted_csv(spark, only).collect() == []


def test_states_are_composed_over_splits(spark):
    # (from outside, from inside): keep, turn, set inside, keep, turn, set outside, turn
    ends = [(False, True), (True, False), (True, True), (False, True), (True, False), (False, False), (True, False)]
    rows = [(f, 10 * k, *e) for f in ("a", "b") for k, e in enumerate(ends[f == "b":])]
    table = spark.createDataFrame(rows, "file string, block long, from_outside boolean, from_inside boolean")
    found = {(r.file, r.block) for r in split_starts(table).collect() if r.inside}
    expected = set()
    for name in ("a", "b"):
        state = False
        for f, block, outside, inside in (r for r in rows if r[0] == name):
            if state:
                expected.add((f, block))
            state = inside if state else outside
    assert found == expected and len(expected) > 4


def test_a_file_is_read_by_as_many_tasks_as_it_has_splits(spark, small_splits, tmp_path):
    path = written(tmp_path, {"a.csv": table(random.Random(9), 300)})
    lines = file_lines(spark, path)
    tasks = lines.select("block", F.spark_partition_id().alias("task")).distinct().collect()
    size = (tmp_path / "a.csv").stat().st_size
    assert len({t for _, t in tasks}) >= size // 300 > 20
    plan = read_quoted_csv(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan csv" not in plan



def test_other_splits_than_before_are_refused(spark, tmp_path):
    path = written(tmp_path, {"a.csv": "id\n1\n"})
    pieces = split_records(file_lines(spark, path), np.array([5]), np.array([False]))
    with pytest.raises(Exception, match="split otherwise"):
        pieces.collect()
