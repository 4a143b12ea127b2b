"""Plan shapes that must hold at any scale."""

import pytest

from reviewlens.operators import embeddings as emb
from reviewlens.operators import filters, keywords, projection, ratings, timesplit, words
from reviewlens.plans import bridges
from reviewlens.plans.registry import REGISTRY

FOLDER = "/root/testdata/sf0.001"
# These check row counts, fit a model or write tables, and so act while the plan is built.
EAGER = {
    "attach_projection", "cached_projection", "csv_round_trip", "knn_graph", "normalize_stream",
    "project_pca", "write_embeddings", "remove_stopwords", "stopword_pipeline", "write_normalized",
    "csv_scan_lines",
    # Written as stored indexes or tables, or worked out in rounds.
    "keyword_rating_counts_indexed", "keyword_rating_distribution_indexed", "knn_descent",
    "load_embeddings_bucketed", "platform_mix_stored", "region_summary_stored",
    "select_region_stored", "spectral_layout", "closest_to_centroid_cells", "representatives_cells",
    "embed_texts_semantic",
    # The longest form of the lexicon is looked up.
    "break_words", "normalize_by_lexicon",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_queries_are_lazy_and_multiply_no_tables(spark, name):
    spark.sparkContext.setJobGroup(f"build {name}", name)
    try:
        df = REGISTRY[name](spark, FOLDER)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"build {name}")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # Each table read costs one small job that looks at the file's schema.
    assert name in EAGER or len(jobs) <= 5
    text = plan(df)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark):
    stored = bridges.table(spark, FOLDER, "documents").selectExpr(
        "string(doc_id) id", "lang platform", "n_chars", "text", "source"
    )
    text = plan(filters.filter_reviews(stored, platform="en").select("id", "n_chars"))
    assert "EqualTo(lang,en)" in text
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in text


def test_date_filter_reaches_a_typed_scan(spark, tmp_path):
    path = str(tmp_path / "reviews")
    bridges.source_a(spark, FOLDER).write.parquet(path)
    from reviewlens.sources.tables import harmonise_reviews

    reviews = harmonise_reviews(spark.read.parquet(path), "alpha")
    text = plan(filters.filter_reviews(reviews, "2020-01-01").select("id"))
    assert "GreaterThanOrEqual(date,2020-01-01)" in text
    assert "ReadSchema: struct<id:bigint,date:date>" in text


def test_top_words_has_no_window_and_one_token_shuffle(spark):
    frequency = words.word_frequency(bridges.reviews(spark, FOLDER), sort=False)
    df = words.top_words(frequency, 20)
    df.collect()
    text = plan(df)
    assert "Window" not in text
    final = text.split("Initial Plan")[0]
    assert "TakeOrderedAndProject" in final and "ReusedExchange" in final


def test_rating_statistics_shuffle_counts_only(spark):
    text = plan(ratings.rating_summary(bridges.ratings(spark, FOLDER)))
    first = text.split("Exchange")[-1]
    assert "partial_count(1)" in first and "percentile" not in first
    assert text.count("Exchange hashpartitioning") == 2


def test_keyword_lookup_has_no_explode_of_tokens(spark):
    df = bridges.reviews(spark, FOLDER)
    text = plan(keywords.keyword_rating_counts(df, "with"))
    assert "Generate" not in text
    # The cheap substring test stands before the tokeniser.
    condition = text[text.index("Filter") :]
    assert condition.index("Contains") < condition.index("regexp_extract_all")


def test_small_sides_are_broadcast(spark):
    df = bridges.reviews(spark, FOLDER)
    assert "BroadcastHashJoin" in plan(ratings.dense_reviews(df))
    assert "Join" not in plan(timesplit.early_late_split(df))
    assert "Join" not in plan(words.remove_stopwords(df, ["the"]))
    placed = bridges.vectors(spark, FOLDER).select("id", "embedding", "rating")
    top = plan(emb.closest_to_centroid(placed, filters.F.col("rating") > 5))
    assert "TakeOrderedAndProject" in top and "Join" not in top


def test_row_index_sorts_without_a_single_task_window(spark):
    vectors = bridges.vectors(spark, FOLDER).select("platform", "id")
    text = plan(projection.row_index(vectors, "platform", "id"))
    assert "BroadcastHashJoin" in text
    # The only window in one task is over one row per partition.
    assert text.count("Exchange SinglePartition") <= 1


def test_copies_of_a_vector_are_limited_before_the_shuffle(spark):
    from reviewlens.operators.neighbours import _distinct_vectors

    text = plan(_distinct_vectors(bridges.vectors(spark, FOLDER).select("id", "embedding"), 5))
    below = text[text.rindex("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below
