"""The index from words to reviews: same rows as the scan, one bucket read, hot words spread."""

import datetime

import pytest

from reviewlens.operators import keywords, postings
from reviewlens.storage import scratch_path


def reviews(spark, rows):
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame(
        [(i, p, day, r, t) for i, p, r, t in rows],
        "id string, platform string, date date, rating double, text string",
    )


@pytest.fixture(scope="module")
def table(spark):
    # "common" is in all texts and every twelfth text has nothing else.
    words = ["plot", "actor", "scene", "ending", "music", "film"]
    rows = []
    for n in range(3000):
        own = " ".join(words[k % 6] + str(n % 7 if k % 2 else "") for k in range(n % 12))
        rows.append((f"r{n:05d}", "alpha" if n % 3 else "beta", None if n % 17 == 0 else float(n % 10 + 1), f"Common {own} common"))
    rows += [("x", "alpha", 5.0, None), ("y", "beta", 5.0, ""), ("r00001", "alpha", 2.0, "Common plot")]
    return reviews(spark, rows).cache()


@pytest.fixture(scope="module")
def index(spark, table):
    path = scratch_path(spark, "test-postings")
    for batch in range(2):
        postings.write_postings(table.where(f"hash(id) % 2 <> 0 = {bool(batch)}"), path, f"b{batch}", parts=8)
    return path


@pytest.mark.parametrize("word", ["common", "plot", "actor3", "nowhere", "common plot"])
def test_counts_equal_the_scan(spark, table, index, word):
    found = postings.indexed_rating_counts(spark, index, word).collect()
    assert sorted(found, key=str) == sorted(keywords.keyword_rating_counts(table, word).collect(), key=str)


def test_short_words_and_stopwords_are_in_no_review(spark, index):
    assert postings.indexed_rating_counts(spark, index, "plot", min_chars=5).count() == 0
    assert postings.indexed_rating_counts(spark, index, "plot", stopwords=["plot"]).count() == 0


@pytest.mark.parametrize("asked", [{"alpha": "plot", "beta": "music"}, {"beta": "common"}, {"gamma": "plot", "alpha": "no"}])
def test_distribution_equals_the_scan(spark, table, index, asked):
    found = postings.indexed_rating_distribution(spark, index, asked).collect()
    assert sorted(found) == sorted(keywords.keyword_rating_distribution(table, asked).collect())


def test_a_lookup_reads_one_bucket(spark, index):
    hits = postings.read_postings(spark, index, ["plot"])
    (bucket,) = spark.range(1).select(postings.bucket_of(postings.F.lit("plot"))).first()
    scan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(word, [plot])]" in scan or "EqualTo(word,plot)" in scan
    files = {r[0] for r in hits.select("_metadata.file_path").distinct().collect()}
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    every = spark.read.parquet(index).inputFiles()
    assert len(files) < len(every) / 4


def test_a_hot_word_lies_in_several_files(spark, index):
    hits = postings.read_postings(spark, index, ["common"])
    sizes = [r["count"] for r in hits.groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 3000 / 2


def test_a_batch_written_again_replaces_itself(spark, table):
    path = scratch_path(spark, "test-postings")
    few = table.where("id < 'r00100'")
    for _ in range(2):
        postings.write_postings(few, path, "one")
    once = postings.read_postings(spark, path, ["common"]).count()
    assert once == few.count()
    postings.write_postings(table.where("id between 'r00100' and 'r00199'"), path, "two")
    assert postings.read_postings(spark, path, ["common"]).count() == once + 100
    with pytest.raises(ValueError):
        postings.write_postings(few, path, "a/b")


def test_no_index_and_no_reviews(spark, table):
    nowhere = scratch_path(spark, "test-postings")
    assert postings.indexed_rating_counts(spark, nowhere, "plot").count() == 0
    assert postings.indexed_rating_distribution(spark, nowhere, {"alpha": "plot"}).count() == 10
    postings.write_postings(table.limit(0), nowhere, "none")
    assert postings.indexed_rating_counts(spark, nowhere, "plot").count() == 0
