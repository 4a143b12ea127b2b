"""Running counts against the batch results, for any order and cut of the arriving files."""

import datetime
import random

import pytest

from reviewlens.operators.ratings import quarter_counts, rating_trend
from reviewlens.storage import scratch_path
from reviewlens.streaming import running

SCHEMA = "id string, platform string, date date, rating double"


def arrivals(seed, count=400):
    draw = random.Random(seed)
    rows = []
    for k in range(count):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=int(draw.triangular(0, 700, 650)))
        rating = None if draw.random() < 0.1 else draw.randint(1, 20) / 2
        rows.append((f"r{k}", draw.choice(["alpha", "beta"]), day, rating))
    return rows + [("x", None, datetime.date(2021, 1, 1), 3.0), ("y", "alpha", None, 4.0), ("z", "beta", None, None)]


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


class Feed:
    def __init__(self, spark, name):
        self.spark, self.schema = spark, spark.createDataFrame([], SCHEMA).schema
        self.source, self.target, self.checkpoint = (scratch_path(spark, f"{name}-{k}") for k in "stc")

    def arrive(self, *files):
        for rows in files:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)

    def run(self, **how):
        running.count_arrivals(self.spark, self.source, self.schema, self.target, self.checkpoint, **how)
        return running.read_running(self.spark, self.target)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_cut_gives_the_batch_result(spark, seed):
    rows = arrivals(seed)
    table = spark.createDataFrame(rows, SCHEMA)
    random.Random(seed).shuffle(rows)
    cuts = sorted(random.Random(seed + 5).sample(range(1, len(rows)), 4))
    files = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    feed = Feed(spark, "feed")
    feed.arrive(*files[:3])
    feed.run(files_per_batch=2)
    feed.arrive(*files[3:])
    found = feed.run(files_per_batch=1)
    assert rounded(found.collect()) == rounded(running.daily_sums(table).collect())
    for unit in ("day", "week", "month"):
        ours = running.running_trend(found, unit, min_n=2, with_sd=True)
        theirs = rating_trend(table, unit, min_n=2, with_sd=True)
        assert ours.columns == theirs.columns and rounded(ours.collect()) == rounded(theirs.collect())
    assert rounded(running.running_quarters(found).collect()) == rounded(quarter_counts(table).collect())


def test_a_restart_repeats_nothing(spark):
    feed = Feed(spark, "again")
    rows = arrivals(3, 60)
    feed.arrive(rows[:40])
    first = rounded(feed.run().collect())
    assert rounded(feed.run().collect()) == first
    batches = spark.read.parquet(f"{feed.target}/batches").select("batch").distinct().count()
    # A batch written again, as after a failure between writing and remembering it.
    last = spark.read.parquet(f"{feed.target}/batches").where(f"batch = {batches - 1}").drop("batch")
    copy = spark.createDataFrame(last.collect(), last.schema)
    copy.write.mode("overwrite").parquet(f"{feed.target}/batches/batch={batches - 1}")
    assert rounded(running.read_running(spark, feed.target).collect()) == first
    feed.arrive(rows[40:])
    assert rounded(feed.run().collect()) == rounded(running.daily_sums(spark.createDataFrame(rows, SCHEMA)).collect())


def test_snapshots(spark):
    feed = Feed(spark, "snapshots")
    rows = arrivals(4, 90)
    assert running.read_running(spark, feed.target).count() == 0
    running.compact(spark, feed.target)
    for part in (rows[:30], rows[30:60], rows[60:]):
        feed.arrive(part)
        found = rounded(feed.run().collect())
        running.compact(spark, feed.target)
        assert rounded(running.read_running(spark, feed.target).collect()) == found
    assert found == rounded(running.daily_sums(spark.createDataFrame(rows, SCHEMA)).collect())
    plan = running.read_running(spark, feed.target)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_units(spark):
    with pytest.raises(ValueError):
        running.running_trend(running.read_running(spark, "/nowhere-at-all"), "year")
