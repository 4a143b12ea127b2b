import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.functions.tokens import HANGUL
from reviewlens.functions.wordlists import KOREAN_STOPWORDS
from reviewlens.operators import keywords, normalise, words
from reviewlens.plans.registry import REGISTRY
from reviewlens.sources import tables

SCHEMA = "id string, platform string, rating double, text string"


def frame(spark, *rows):
    return spark.createDataFrame([tuple(row) for row in rows], SCHEMA)


def words_of(spark, text):
    tokens = words.tokenize(frame(spark, ("1", "a", 1.0, text)))
    return [row.word for row in tokens.collect()]


def test_tokens(spark):
    assert words_of(spark, "Don't it’s 영화10점 가족 3.14 foo_bar") == [
        "don't", "it’s", "영화10점", "가족", "3.14", "foo_bar",
    ]
    assert words_of(spark, "U.S. a.3 'quoted' 1,000, x--y well-known") == [
        "u.s", "a", "3", "quoted", "1,000", "x", "y", "well", "known",
    ]
    assert words_of(spark, "‘it’ l·l 1;2 m² _ __ _a_1. b_") == [
        "it", "l·l", "1;2", "m", "__", "_a_1", "b_",
    ]
    assert words_of(spark, " ... !") == []
    assert words_of(spark, None) == []


def test_very_long_tokens_are_whole(spark):
    text = "a" * 100_000 + " " + "a1" * 50_000 + " " + "b'" * 50_000
    assert [len(word) for word in words_of(spark, text)] == [100_000, 100_000, 99_999]


def test_frequency_filters(spark):
    df = frame(
        spark,
        ("1", "a", 9.0, "영화 좋다 좋다 good a1 12 x"),
        ("2", "a", 3.0, "Good bad"),
        ("3", "a", None, "good"),
        ("4", "a", 9.0, None),
    )
    assert [tuple(r) for r in words.word_frequency(df).collect()] == [
        ("good", 3), ("a1", 1), ("bad", 1),
    ]
    high = words.word_frequency(df, min_rating=4)
    assert {tuple(r) for r in high.collect()} == {("good", 1), ("a1", 1)}
    korean = words.word_frequency(df, char_class=HANGUL, stopwords=KOREAN_STOPWORDS)
    assert [tuple(r) for r in korean.collect()] == [("좋다", 2)]
    everything = words.word_frequency(df, char_class=None, min_chars=1, stopwords=[])
    assert everything.count() == 7


def test_top_words_keeps_ties(spark):
    counts = spark.createDataFrame([("d", 5), ("b", 5), ("c", 5), ("a", 4)], "word string, n long")
    assert {r.word for r in words.top_words(counts, 2).collect()} == {"b", "c", "d"}
    assert words.top_words(counts, 10).count() == 4
    assert words.top_words(counts.limit(0), 3).count() == 0
    assert [r.word for r in words.cloud_words(counts, 2, 1).collect()] == ["b", "c"]
    assert [r.word for r in words.cloud_words(counts, 9, 5).collect()] == ["b", "c", "d"]


def test_top_keywords(spark):
    df = frame(spark, ("1", "a", 1.0, "plot plot plot cat cat ox ox ox ox"))
    found = words.top_keywords(df, k=5, min_chars=3, min_n=3)
    assert [tuple(r) for r in found.collect()] == [("plot", 3)]


def test_remove_stopwords_in_both_ways(spark):
    df = frame(
        spark,
        ("1", "a", 1.0, "The film, and THE plot"),
        ("2", "a", 1.0, "the and"),
        ("3", "a", 1.0, None),
        ("4", "b", 2.0, "The film, and THE plot"),
    )
    table = spark.createDataFrame([("the",), ("and",), (None,)], "word string")
    for stop in (table, ["the", "and", None]):
        dropped = words.remove_stopwords(df, stop)
        assert sorted((r.id, r.text_nostop) for r in dropped.collect()) == [
            ("1", "film plot"), ("4", "film plot"),
        ]
        kept = words.remove_stopwords(df, stop, keep_empty=True)
        assert sorted((r.id, r.text_nostop) for r in kept.collect()) == [
            ("1", "film plot"), ("2", ""), ("3", ""), ("4", "film plot"),
        ]
        assert kept.columns == [*df.columns, "text_nostop"]
    assert words.remove_stopwords(df, ["plot"]).count() == 3


def test_stopword_tables(spark, tmp_path):
    assert {r.word for r in tables.load_stopwords(spark, str(tmp_path / "none")).collect()} == {
        "하다", "되다", "이다",
    }
    (tmp_path / "stop.txt").write_text(" 보다 \n\n하다\n", encoding="utf-8")
    loaded = tables.load_stopwords(spark, str(tmp_path / "stop.txt"))
    assert sorted(r.word for r in loaded.collect()) == sorted(["하다", "되다", "이다", "보다"])
    merged = tables.merge_stopwords(tables.english_stopwords(spark), tables.film_stopwords(spark))
    lexicons = {r.word: r.lexicon for r in merged.collect()}
    assert lexicons["the"] == "english" and lexicons["movie"] is None
    assert lexicons["very"] == "english" and "blu ray" in lexicons
    assert merged.count() == len(lexicons)


def test_keyword_counts(spark):
    df = frame(
        spark,
        ("1", "a", 8.0, "plot plot"),
        ("2", "a", 8.0, "a Plot."),
        ("3", "a", 2.0, "the plot"),
        ("3", "a", 2.0, "the plot"),
        ("4", "a", 2.0, "plots"),
        ("5", "a", None, "plot"),
    )
    rows = {r.rating: (r.n, r.prop) for r in keywords.keyword_rating_counts(df, "plot").collect()}
    assert rows == {8.0: (2, 0.5), 2.0: (1, 0.25), None: (1, 0.25)}
    assert keywords.keyword_rating_counts(df, "plot", stopwords=["plot"]).count() == 0
    assert keywords.keyword_rating_counts(df, "plot", min_chars=5).count() == 0
    assert keywords.keyword_rating_counts(df, "Plot").count() == 0


def test_keyword_distribution_is_complete(spark):
    df = frame(
        spark,
        ("1", "alpha", 8.5, "good plot"),
        ("2", "alpha", 11.0, "good"),
        ("3", "alpha", None, "good"),
        ("4", "beta", 8.0, "good"),
    )
    result = keywords.keyword_rating_distribution(df, {"beta": "plot", "alpha": "good"})
    rows = {(r.platform, r.rating): (r.platform_order, r.n, r.prop) for r in result.collect()}
    assert len(rows) == 21
    assert rows["alpha", 8] == (2, 1, 0.5) and rows["alpha", None] == (2, 1, 0.5)
    assert all(rows["beta", level] == (1, 0, 0.0) for level in range(1, 11))


def test_normalise_keeps_content_lemmas(spark):
    def fixed_analyser():
        tokens = [
            ("재밌", "VA", "재밌다"), ("영화", "NNG", None), ("를", "JKS", None), ("하", "VV", "하다"),
            (" 점 ", "NNB", ""), ("다", "EF", None), (" ", "MAG", " "), ("이", "VCP", "이다"),
        ]
        return lambda text: tokens if text else []

    df = frame(spark, ("1", "a", 1.0, "x"), ("2", "a", 1.0, ""), ("3", "a", 1.0, None))
    result = normalise.normalize_reviews(df, make_analyser=fixed_analyser)
    assert {r.id: (r.original_text, r.normalized_text) for r in result.collect()} == {
        "1": ("x", "재밌다 영화 점"), "2": ("", ""), "3": (None, ""),
    }
    own = normalise.normalize_reviews(df, make_analyser=fixed_analyser, stopwords=["영화"])
    assert own.where("id = '1'").first().normalized_text == "재밌다 하다 점 이다"


def test_analyser_is_made_once_per_task(spark, tmp_path):
    mark = str(tmp_path / "made")

    def counting_analyser():
        with open(mark, "a") as file:
            file.write("x")
        return lambda text: [(text, "NNG", None)]

    df = spark.range(1000).coalesce(1).select(F.col("id"), F.lit("w").alias("text"))
    assert normalise.normalize_reviews(df, make_analyser=counting_analyser).count() == 1000
    normalise.normalize_reviews(df, make_analyser=counting_analyser).agg(
        F.max("normalized_text")
    ).collect()
    with open(mark) as file:
        assert len(file.read()) <= 2


@pytest.mark.parametrize("k", [1, 3])
def test_top_words_contains_the_hard_cap(spark, k):
    df = frame(spark, ("1", "a", 1.0, "aa bb bb cc cc dd dd dd"))
    frequency = words.word_frequency(df, sort=False)
    tied = {r.word for r in words.top_words(frequency, k).collect()}
    assert {r.word for r in words.cloud_words(frequency, k, 1).collect()} <= tied


def test_stored_words_serve_all_operators(spark):
    df = frame(
        spark,
        ("1", "alpha", 8.0, "The good plot"),
        ("2", "alpha", 3.0, "A plot, the plot!"),
        ("3", "alpha", 3.0, None),
    )
    stored = words.with_words(df)
    assert dict(stored.dtypes)["text"] == "array<string>"

    def same(function):
        one, two = (sorted(map(tuple, function(x).collect()), key=repr) for x in (df, stored))
        assert one == two and one

    same(lambda x: words.tokenize(x))
    same(lambda x: words.word_frequency(x))
    same(lambda x: keywords.keyword_rating_counts(x, "plot"))
    same(lambda x: keywords.keyword_rating_distribution(x, {"alpha": "good"}))
    stop = spark.createDataFrame([("the",)], "word string")
    for words_out in (stop, ["the"]):
        for keep in (True, False):
            same(lambda x: words.remove_stopwords(x, words_out, keep_empty=keep).drop("text"))


def test_a_null_stopword_is_no_word(spark):
    df = frame(spark, ("1", "a", 9.0, "the plot"))
    listed = words.word_frequency(df, stopwords=["the", None]).collect()
    assert [tuple(r) for r in listed] == [("plot", 1)]
    assert words.word_frequency(df, stopwords=[None]).count() == 2


def test_removal_makes_one_plan_per_type_of_argument(spark):
    """No job runs while the plan is built, however long the stopword table is."""
    df = frame(spark, ("1", "a", 9.0, "w1 w7 plot"))
    stop = spark.range(20_000).selectExpr("concat('w', id) AS word")
    spark.sparkContext.setJobGroup("stop", "stop")
    cleaned = words.remove_stopwords(df, stop)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("stop")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert cleaned.first().text_nostop == "plot"


def test_merged_stopwords_of_two_tables_of_texts(spark, tmp_path):
    talk = [(1, 0, "user", "Movie says Great"), (1, 1, "assistant", None)]
    columns = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(talk, columns).write.parquet(str(tmp_path / "conversations.parquet"))
    items = spark.createDataFrame([("a", "great cast"), ("b", "")], "item_id string, text string")
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    found = {r.word: r.lexicon for r in REGISTRY["merge_stopwords"](spark, str(tmp_path)).collect()}
    assert found.pop("says") == "talk" and found.pop("great") == "talk" and found.pop("cast") == "items"
    assert set(found.values()) <= {"talk", None}


def test_analysed_texts_leave_in_slices(monkeypatch):
    """Tokens of a whole batch of rows are never held at once; long texts come in fewer rows."""
    texts = pa.array(["word " * 300, None, "", *["x"] * 600, "word " * 300])
    assert [len(part) for part in normalise._slices(texts)] == [256, 256, 92]
    monkeypatch.setattr(normalise, "ANALYSED_BYTES", 1000)
    sizes = [len(part) for part in normalise._slices(texts)]
    assert sizes[0] == 1 and sizes[-1] == 1 and sum(sizes) == len(texts)


def test_analyser_runs_on_batches_of_rows(spark):
    df = spark.range(3000).coalesce(1).select("id", F.lit("some words").alias("text"))
    tokens = normalise._analysed(df.select(F.col("id").cast("string"), "text"), normalise.simple_analyser)
    assert tokens.count() == 3000
    assert "MapInArrow" in normalise.normalize_reviews(
        df, make_analyser=normalise.simple_analyser
    )._jdf.queryExecution().executedPlan().toString()


def test_a_table_of_few_stopwords_moves_no_words(spark, monkeypatch):
    """Few words are tested in the scan, other tables joined; the results are the same."""
    df = frame(spark, ("1", "a", 1.0, "the film the plot"), ("2", "a", 1.0, "the"), ("3", "a", 1.0, None), ("1", "b", 2.0, "plot"))
    stop = spark.createDataFrame([("the",), ("of",), ("the",), (None,)], "word string")
    got = []
    for listed, chars in ((4096, 100), (2, 100), (1, 100), (4096, 2)):
        monkeypatch.setattr(words, "LISTED", listed)
        monkeypatch.setattr(words, "LISTED_CHARS", chars)
        cleaned = words.remove_stopwords(df, stop, keep_empty=True)
        got.append(sorted((r.id, r.platform, r.text_nostop) for r in cleaned.collect()))
        final = cleaned._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # What is joined was found empty, or not.
        assert ("SortMergeJoin" in final or "HashJoin" in final) == (listed == 1 or chars == 2)
    assert got[0] == [("1", "a", "film plot"), ("1", "b", "plot"), ("2", "a", ""), ("3", "a", "")]
    assert all(rows == got[0] for rows in got)
    assert words.remove_stopwords(df, stop.limit(0)).count() == 3
