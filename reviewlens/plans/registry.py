"""One query per operator, each over whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.scalars import title_key
from reviewlens.functions.tokens import word_array
from reviewlens.operators import embeddings as emb
from reviewlens.operators import (
    bucketed,
    cells,
    descent,
    filters,
    keywords,
    lexicon,
    neighbours,
    normalise,
    postings,
    projection,
    quantiles,
    ratings,
    regions,
    semantic,
    spectral,
    timesplit,
    words,
)
from reviewlens.plans import bridges
from reviewlens.sources import pages, tables
from reviewlens.storage import scratch_path
from reviewlens.streaming import running
from reviewlens.streaming.normalise import normalize_stream

Query = Callable[[SparkSession, str], DataFrame]

# Parameters of the registered queries; the oracle's SQL uses the same values.
START, END = "2020-01-01", "2021-12-31"
CUT = "2021-04-01"
SHARE = 0.3
KEYWORDS = {"beta": "der", "alpha": "with"}
STOPWORDS = ["the", "and", "with", "der", "les"]
# A script class outside ASCII, and the lines of a stopword file.
ACCENTED = "[à-ÿ]"
WORD_FILE = ["of", " der ", "", "die", "les"]
REGION = (0.0, 0.2, -0.1, 0.1)

REGISTRY: dict[str, Query] = {}


def register(name: str, view: Callable | None = None) -> Callable:
    """Adds a query; with a view, the function gets that view's frame."""

    def add(function: Callable) -> Callable:
        def query(spark: SparkSession, folder: str) -> DataFrame:
            result = function(spark, folder) if view is None else function(view(spark, folder))
            return iso_dates(result)

        REGISTRY[name] = query
        return function

    return add


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which compares the same whatever reads it."""
    return df.withColumns(
        {name: F.col(name).cast("string") for name, kind in df.dtypes if kind == "date"}
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; adding zero turns a negative zero into zero."""
    return df.select(
        [
            (F.round(F.col(name), digits) + F.lit(0.0)).alias(name) if kind == "double" else name
            for name, kind in df.dtypes
        ]
    )


@register("harmonise_union")
def harmonise_union(spark: SparkSession, folder: str) -> DataFrame:
    return bridges.reviews(spark, folder)


@register("filter_date_platform", bridges.reviews)
def filter_date_platform(df: DataFrame) -> DataFrame:
    kept = filters.filter_reviews(df, START, END, "alpha", choices=["alpha", "beta"])
    return kept.where(F.col("rating").isNotNull()).select("id", "platform", "date", "rating")


@register("filter_platforms_rating", bridges.ratings)
def filter_platforms_rating(df: DataFrame) -> DataFrame:
    return filters.filter_rating(filters.filter_reviews(df, end=END, platforms=["alpha"]), 3, 8)


@register("date_bounds", bridges.ratings)
def date_bounds(df: DataFrame) -> DataFrame:
    return filters.date_bounds(df)


@register("trend_axis", bridges.reviews)
def trend_axis(df: DataFrame) -> DataFrame:
    return ratings.trend_axis(ratings.rating_trend(df, "month", min_n=3))


@register("rating_distribution", bridges.ratings)
def rating_distribution(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_distribution(df))


@register("rating_distribution_truncated", bridges.ratings)
def rating_distribution_truncated(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_distribution(df, fractional="truncate"))


@register("rating_summary_skip", bridges.ratings)
def rating_summary_skip(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_summary(df))


@register("rating_summary_propagate", bridges.ratings)
def rating_summary_propagate(df: DataFrame) -> DataFrame:
    # A null rating is one whose id is a multiple of 19, so most remainders are complete groups.
    part = df.withColumn("part", F.col("id").cast("long") % 19)
    return rounded(ratings.rating_summary(part, ("platform", "part"), null_policy="propagate"))


@register("rating_trend_day", bridges.ratings)
def rating_trend_day(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_trend(df, "day", min_n=3))


@register("rating_trend_week", bridges.ratings)
def rating_trend_week(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_trend(df, "week"))


@register("rating_trend_month", bridges.ratings)
def rating_trend_month(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_trend(df, "month", min_n=1, with_sd=True))


@register("quarter_counts", bridges.ratings)
def quarter_counts(df: DataFrame) -> DataFrame:
    return ratings.quarter_counts(df).orderBy("period_q", "platform")


def _running(df: DataFrame) -> DataFrame:
    """Daily sums of all ratings, which arrive in files and are counted three at a time."""
    spark, rows = df.sparkSession, df.select("platform", "date", "rating")
    source, target, checkpoint = (scratch_path(spark, f"arrivals-{k}") for k in range(3))
    rows.repartition(8).write.parquet(source)
    running.count_arrivals(spark, source, rows.schema, target, checkpoint, files_per_batch=3)
    return running.read_running(spark, target)


@register("running_trend_month", bridges.ratings)
def running_trend_month(df: DataFrame) -> DataFrame:
    return rounded(running.running_trend(_running(df), "month", min_n=1, with_sd=True))


@register("running_quarter_counts", bridges.ratings)
def running_quarter_counts(df: DataFrame) -> DataFrame:
    return running.running_quarters(_running(df))


@register("dense_periods", bridges.reviews)
def dense_periods(df: DataFrame) -> DataFrame:
    return ratings.dense_periods(df)


@register("dense_periods_all_platforms", bridges.reviews)
def dense_periods_all_platforms(df: DataFrame) -> DataFrame:
    return ratings.dense_periods(df, min_n=5, require_all_platforms=True)


@register("dense_reviews", bridges.reviews)
def dense_reviews(df: DataFrame) -> DataFrame:
    return ratings.dense_reviews(df).select("id", "platform", "date", "rating", "period_q")


@register("rating_histogram", bridges.ratings)
def rating_histogram(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_histogram(df))


@register("rating_boxstats", bridges.ratings)
def rating_boxstats(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_boxstats(df))


@register("rating_density", bridges.ratings)
def rating_density(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_density(df))


@register("rating_density_extended", bridges.reviews)
def rating_density_extended(df: DataFrame) -> DataFrame:
    return rounded(ratings.rating_density(df, extend=True))


@register("early_late_split", bridges.reviews)
def early_late_split(df: DataFrame) -> DataFrame:
    kept = filters.filter_reviews(df, start=START)
    return timesplit.early_late_split(kept, SHARE).select(
        "id", "platform", "date", "cutoff_date", "period_group"
    )


@register("early_late_cutoff", bridges.reviews)
def early_late_cutoff(df: DataFrame) -> DataFrame:
    return timesplit.early_late_cutoff(filters.filter_reviews(df, end=END), CUT).select(
        "id", "platform", "date", "cutoff_date", "period_group"
    )


@register("early_late_summary", bridges.ratings)
def early_late_summary(df: DataFrame) -> DataFrame:
    return rounded(timesplit.early_late_summary(df, SHARE))


@register("early_late_density", bridges.ratings)
def early_late_density(df: DataFrame) -> DataFrame:
    split = timesplit.early_late_split(df, 0.5)
    return rounded(ratings.rating_density(split, ("platform", "period_group")))


@register("early_late_density_cutoff", bridges.reviews)
def early_late_density_cutoff(df: DataFrame) -> DataFrame:
    split = timesplit.early_late_cutoff(ratings.dense_reviews(df, min_n=10), CUT)
    return rounded(ratings.rating_density(split, ("platform", "period_group")))


@register("early_late_normalised", bridges.ratings)
def early_late_normalised(df: DataFrame) -> DataFrame:
    return rounded(timesplit.early_late_normalised(df, "1997-04-01"))


@register("tokenize", bridges.reviews)
def tokenize(df: DataFrame) -> DataFrame:
    return words.tokenize(df)


@register("word_frequency", bridges.reviews)
def word_frequency(df: DataFrame) -> DataFrame:
    return words.word_frequency(df)


@register("word_frequency_high", bridges.reviews)
def word_frequency_high(df: DataFrame) -> DataFrame:
    return words.word_frequency(df, min_rating=8)


@register("word_frequency_low", bridges.reviews)
def word_frequency_low(df: DataFrame) -> DataFrame:
    return words.word_frequency(df, max_rating=3, min_chars=3)


@register("word_frequency_stopped", bridges.reviews)
def word_frequency_stopped(df: DataFrame) -> DataFrame:
    return words.word_frequency(df, char_class=None, stopwords=STOPWORDS)


@register("word_frequency_stored", bridges.reviews)
def word_frequency_stored(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "words")
    words.with_words(df).select("id", "rating", "text").write.parquet(path)
    return words.word_frequency(df.sparkSession.read.parquet(path), min_rating=8)


@register("word_frequency_script", bridges.reviews)
def word_frequency_script(df: DataFrame) -> DataFrame:
    kept = df.where(F.col("text").isNotNull())
    return words.word_frequency(kept, char_class=ACCENTED, stopwords=["été", "même", None, "más"])


@register("top_words", bridges.reviews)
def top_words(df: DataFrame) -> DataFrame:
    return words.top_words(words.word_frequency(df, sort=False), 2000)


@register("top_keywords", bridges.reviews)
def top_keywords(df: DataFrame) -> DataFrame:
    return words.top_keywords(df)


@register("cloud_words", bridges.reviews)
def cloud_words(df: DataFrame) -> DataFrame:
    return words.cloud_words(words.word_frequency(df, min_rating=3, sort=False), 150)


def _lexicon(df: DataFrame, lexicon: str) -> DataFrame:
    found = words.tokenize(df, keep=()).distinct()
    return found.withColumn("lexicon", F.lit(lexicon))


@register("merge_stopwords")
def merge_stopwords(spark: SparkSession, folder: str) -> DataFrame:
    turns = bridges.table(spark, folder, "conversations")
    items = bridges.table(spark, folder, "benchmark")
    return tables.merge_stopwords(
        _lexicon(turns, "talk"), _lexicon(items, "items"), tables.film_stopwords(spark)
    )


def _frequent(df: DataFrame) -> DataFrame:
    return words.top_words(words.word_frequency(df, char_class=None, sort=False), 60)


def _frequent_rows(df: DataFrame) -> list:
    """The words of a bounded top list, for use as a plain list."""
    return _frequent(df).select("word").collect()


@register("remove_stopwords", bridges.reviews)
def remove_stopwords(df: DataFrame) -> DataFrame:
    listed = [row["word"] for row in _frequent_rows(df)]
    return words.remove_stopwords(df, [*listed, None]).select("id", "text_nostop")


@register("remove_stopwords_join", bridges.reviews)
def remove_stopwords_join(df: DataFrame) -> DataFrame:
    return words.remove_stopwords(df, _frequent(df), keep_empty=True).select("id", "text_nostop")


@register("stopword_pipeline")
def stopword_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    lines = scratch_path(spark, "word-file")
    spark.createDataFrame([(w,) for w in WORD_FILE], "value string").write.text(lines)
    listed = tables.load_stopwords(spark, lines, []).withColumn("lexicon", F.lit("file"))
    merged = tables.merge_stopwords(
        tables.english_stopwords(spark), tables.film_stopwords(spark), listed
    )
    cleaned = words.remove_stopwords(bridges.reviews(spark, folder), merged)
    path = tables.write_reviews(cleaned.select("id", "text_nostop"), scratch_path(spark, "clean"))
    return tables.read_reviews_csv(spark, path)


@register("keyword_rating_counts", bridges.reviews)
def keyword_rating_counts(df: DataFrame) -> DataFrame:
    return rounded(keywords.keyword_rating_counts(df, "der", stopwords=["les"]))


@register("keyword_rating_distribution", bridges.reviews)
def keyword_rating_distribution(df: DataFrame) -> DataFrame:
    return rounded(keywords.keyword_rating_distribution(df, KEYWORDS))


def _indexed(df: DataFrame) -> str:
    """An index of all reviews, written in three batches, of which the second comes twice."""
    path = scratch_path(df.sparkSession, "postings")
    for batch in (0, 1, 1, 2):
        part = df.where(F.pmod(F.xxhash64("id"), F.lit(3)) == batch)
        postings.write_postings(part, path, f"b{batch}")
    return path


@register("keyword_rating_counts_indexed", bridges.reviews)
def keyword_rating_counts_indexed(df: DataFrame) -> DataFrame:
    path = _indexed(df)
    return rounded(
        postings.indexed_rating_counts(df.sparkSession, path, "der", stopwords=["les"])
    )


@register("keyword_rating_distribution_indexed", bridges.reviews)
def keyword_rating_distribution_indexed(df: DataFrame) -> DataFrame:
    path = _indexed(df)
    return rounded(postings.indexed_rating_distribution(df.sparkSession, path, KEYWORDS))


@register("normalize_reviews", bridges.reviews)
def normalize_reviews(df: DataFrame) -> DataFrame:
    return normalise.normalize_reviews(df, stopwords=STOPWORDS)


def suffix_analyser() -> normalise.Analyser:
    """A plugged-in analyser: long words lose their last letter, which gives them a lemma."""
    plain = normalise.simple_analyser()
    return lambda text: [
        (form, tag, form[:-1] if tag == "NNG" and len(form) > 5 else None if len(form) % 2 else "")
        for form, tag, _ in plain(text)
    ]


@register("normalize_reviews_analyser", bridges.reviews)
def normalize_reviews_analyser(df: DataFrame) -> DataFrame:
    found = normalise.normalize_reviews(df, make_analyser=suffix_analyser, stopwords=STOPWORDS)
    return found.select("id", "normalized_text")


def _glued(df: DataFrame) -> DataFrame:
    """The reviews with their words stuck together in twos, as in a script without blanks."""
    return df.withColumn("text", F.regexp_replace("text", r"(\p{L}+) (\p{L}+)", "$1$2"))


def _word_costs(df: DataFrame) -> DataFrame:
    """The reviews' own words; a word costs less, the more often it stands."""
    counted = words.word_frequency(df, char_class=None, sort=False)
    cost = (64 - F.length(F.bin("n"))).cast("long")
    return counted.select(
        F.col("word").alias("form"), F.lit("NNG").alias("tag"), F.lit(None).cast("string").alias("lemma"),
        cost.alias("cost"),
    )


@register("break_words", bridges.reviews)
def break_words(df: DataFrame) -> DataFrame:
    stuck = _glued(df).select(F.explode(word_array(F.col("text"))).alias("word"))
    broken = lexicon.break_words(stuck, _word_costs(df))
    forms = F.transform("tokens", lambda token: F.concat_ws("/", token["form"], token["tag"]))
    return broken.select("word", F.array_join(forms, " ").alias("forms"))


@register("normalize_by_lexicon", bridges.reviews)
def normalize_by_lexicon(df: DataFrame) -> DataFrame:
    found = lexicon.normalize_by_lexicon(_glued(df), _word_costs(df), stopwords=STOPWORDS)
    return found.select("id", "normalized_text")


@register("write_normalized", bridges.reviews)
def write_normalized(df: DataFrame) -> DataFrame:
    found = normalise.normalize_reviews(df, stopwords=STOPWORDS)
    path = tables.write_normalized(found, scratch_path(df.sparkSession, "normalized"))
    return tables.read_reviews_csv(df.sparkSession, path)


@register("merge_normalized")
def merge_normalized(spark: SparkSession, folder: str) -> DataFrame:
    raw = bridges.reviews(spark, folder)
    normalized = normalise.normalize_reviews(raw.where(F.col("platform") == "beta"))
    merged = tables.merge_normalized(raw, normalized)
    return merged.select("id", "platform", "rating", "normalized_text")


def _both_texts(spark: SparkSession, folder: str) -> DataFrame:
    sources = bridges.source_a(spark, folder), bridges.source_b(spark, folder)
    return tables.union_reviews(*map(tables.select_text_column, sources))


@register("select_text_column")
def select_text_column(spark: SparkSession, folder: str) -> DataFrame:
    return _both_texts(spark, folder)


@register("load_texts")
def load_texts(spark: SparkSession, folder: str) -> DataFrame:
    lines = bridges.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.explode(F.split("text", "[.]")).alias("line")
    )
    return tables.load_texts(lines, "line")


def _escaped(text):
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of every document, as the reviews on that document's page."""
    return bridges.table(spark, folder, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.transform(
            F.split("text", "\n"), lambda line, i: F.struct(i.alias("place"), line.alias("line"))
        ).alias("lines"),
    )


# Reviews of both layouts; every third has the elements that a review may have besides.
ARTICLE = (
    '<article class="box user-review-item"><span aria-label="ann%1$s\'s rating: %1$s"></span>'
    '<h3>Line %1$s</h3><div data-testid="review-overflow"><div>%2$s</div></div></article>'
)
ARTICLE_MORE = (
    '<article class="user-review-item box"><span aria-label="ann%1$s\'s rating: %1$s"></span>'
    "<h3>Line %1$s</h3>"
    '<div data-testid="reviews-author"><a data-testid="author-link">by &eacute;%1$s</a></div>'
    '<div data-testid="review-summary"><h3>Sum %3$s</h3></div>'
    '<div data-testid="review-overflow"><div>%2$s</div></div></article>'
)
CARD = (
    '<li data-report-time="20200105" class="area_card _item" data-report-writer-id="w%1$s">'
    '<div class="area_title_box"><div class="area_text_box">10 / %3$s</div></div>'
    '<div class="area_review_content"><span class="desc_text">%2$s</span></div>'
    '<button class="area_button_upvote on"><span class="this_text_number _count_num">%1$s</span>'
    "</button></li>"
)
CARD_MORE = (
    '<li data-report-time="20200105" class="area_card _item" data-report-writer-id="w%1$s"'
    ' data-report-title="told &quot;%1$s&quot;">'
    '<div class="area_title_box"><div class="area_text_box">10 / %3$s</div></div>'
    '<div class="area_review_content"><span class="desc_text">%2$s</span></div>'
    '<button class="area_button_upvote on"><span class="this_text_number _count_num">%1$s</span>'
    '</button><button class="area_button_downvote"><span class="this_text_number _count_num">%3$s'
    "</span></button></li>"
)


def _saved_pages(spark: SparkSession, folder: str, plain: str, more: str) -> DataFrame:
    """One page per document, one review in the given layout per line."""

    def review(item):
        values = item["place"], _escaped(item["line"]), item["place"] % 10 + 1
        every_third = item["place"] % 3 == 0
        return F.when(every_third, F.format_string(more, *values)).otherwise(
            F.format_string(plain, *values)
        )

    reviews = F.transform("lines", review)
    html = F.concat(F.lit("<html><h3>Page</h3><ul>"), F.array_join(reviews, "\n"), F.lit("</ul>"))
    return _lines(spark, folder).select("page_id", html.alias("html"))


@register("extract_article_reviews")
def extract_article_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_article_reviews(_saved_pages(spark, folder, ARTICLE, ARTICLE_MORE))


@register("extract_card_reviews")
def extract_card_reviews(spark: SparkSession, folder: str) -> DataFrame:
    return pages.extract_card_reviews(_saved_pages(spark, folder, CARD, CARD_MORE))


@register("extract_page_title")
def extract_page_title(spark: SparkSession, folder: str) -> DataFrame:
    saved = bridges.table(spark, folder, "pages")
    return pages.extract_page_title(saved).select("page_id", "title")


# Page heads by the remainder of the id: subtitle, hero heading, and the title alone.
HEADS = [
    '<title>No - t</title><h2 data-testid="subtitle">Caf&eacute; &#8217;s <b>%s</b></h2>',
    '<title>No - t</title><h1 class="x" data-testid="hero-title-block__title">&#x27;%s&amp;lt;</h1>',
    "<title>Plain %s &copy; - Site</title>",
]


@register("extract_page_title_branches")
def extract_page_title_branches(spark: SparkSession, folder: str) -> DataFrame:
    saved = bridges.table(spark, folder, "pages")
    head = F.element_at(
        F.array(*[F.format_string(h, "page_id") for h in HEADS]),
        (F.col("page_id") % len(HEADS) + 1).cast("int"),
    )
    articles = pages.extract_page_title(saved.withColumn("html", F.concat(head, "html")))
    card = F.format_string(
        '<div class="title_area type_keep _title_area"><span class="area_text_title">'
        '<strong class="_text">K&#44032; %s</strong></span></div>',
        "page_id",
    )
    cards = pages.extract_page_title(saved.withColumn("html", F.concat(card, "html")), "card")
    return articles.select("page_id", "title").unionByName(cards.select("page_id", "title"))


@register("title_key")
def title_keys(spark: SparkSession, folder: str) -> DataFrame:
    saved = bridges.table(spark, folder, "pages")
    key = title_key(F.col("url"), "_reviews.csv")
    return saved.select("page_id", key.alias("title_key"))


def _crawled_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Source A under the article crawl's headers, which have no date."""
    return bridges.source_a(spark, folder).select(
        F.concat(F.lit("u"), F.col("id") % 89).alias("작성자"),
        F.concat(F.lit("Title "), F.col("id")).alias("제목"),
        F.col("star_rating").cast("string").alias("별점"),
        F.col("content").alias("내용"),
    )


def _crawled(spark: SparkSession, folder: str) -> DataFrame:
    """Source B under the card crawl's headers, all strings, some of them bad."""
    return bridges.source_b(spark, folder).select(
        F.concat(F.lit("w"), F.col("id") % 97).alias("작성자ID"),
        F.when(F.col("id") % 11 == 0, "?")
        .otherwise(F.col("star_rating").cast("string"))
        .alias("별점"),
        F.col("comment").alias("내용"),
        F.date_format("writing_date", "yyyyMMdd").alias("작성일자"),
        F.col("upvote").cast("string").alias("공감수"),
        F.when(F.col("downvote") > 0, F.col("downvote").cast("string"))
        .otherwise("")
        .alias("비공감수"),
    )


@register("standardise_crawl")
def standardise_crawl(spark: SparkSession, folder: str) -> DataFrame:
    cards = tables.standardise_crawl(_crawled(spark, folder), "beta", "card")
    articles = tables.standardise_crawl(_crawled_articles(spark, folder), "alpha", "article")
    return tables.union_reviews(cards, articles)


@register("csv_round_trip")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Texts get blanks at their ends, which have to survive."""

    def back(source: DataFrame, text: str) -> DataFrame:
        padded = source.withColumn(text, F.concat(F.lit("  "), F.col(text), F.lit(" ")))
        path = tables.write_reviews(padded, scratch_path(spark, "reviews"))
        return tables.read_reviews_csv(spark, path)

    alpha = back(bridges.source_a(spark, folder), "content")
    beta = back(bridges.source_b(spark, folder), "comment")
    return tables.union_reviews(
        tables.harmonise_reviews(alpha, "alpha"),
        tables.harmonise_reviews(beta, "beta", text="comment", date="writing_date"),
    )


@register("csv_scan_lines")
def csv_scan_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Texts without line breaks, whose files can be split among tasks."""
    flat = _both_texts(spark, folder).withColumn("text", F.regexp_replace("text", "[\r\n]+", " "))
    path = tables.write_reviews(flat, scratch_path(spark, "lines"))
    return tables.read_reviews_csv(spark, path, multi_line=False)


@register("l2_normalize", bridges.vectors)
def l2_normalize(df: DataFrame) -> DataFrame:
    doubled = df.withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    flat = emb.l2_normalize(doubled).select("id", F.posexplode("embedding").alias("pos", "value"))
    return rounded(flat, 4)


@register("load_embeddings")
def load_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    reviews = bridges.reviews(spark, folder)
    loaded = emb.load_embeddings(reviews, bridges.vectors(spark, folder))
    first = loaded.withColumn("first", F.col("embedding")[0])
    return rounded(first.select("id", "platform", "date", "rating", "first"), 4)


@register("load_embeddings_bucketed")
def load_embeddings_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    names = []
    for df in (bridges.reviews(spark, folder), bucketed.first_vectors(bridges.vectors(spark, folder))):
        path = scratch_path(spark, "by-id")
        names.append(bucketed.save_by_id(df, f"t_{path.rsplit('-', 1)[1]}", path, buckets=8))
    first = bucketed.join_by_id(spark, *names).withColumn("first", F.col("embedding")[0])
    return rounded(first.select("id", "platform", "date", "rating", "first"), 4)


@register("load_embeddings_first_match")
def load_embeddings_first_match(spark: SparkSession, folder: str) -> DataFrame:
    stored = bridges.table(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 2).cast("string").alias("id"), "vec_id", "embedding"
    )
    loaded = emb.load_embeddings(bridges.reviews(spark, folder), stored, position="vec_id")
    return rounded(loaded.select("id", F.col("embedding")[0].alias("first")), 4)


@register("load_embeddings_repeated")
def load_embeddings_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Every id is stored twice, with its vector and with its negative; each review comes once."""
    stored = bridges.vectors(spark, folder).select("id", "embedding")
    twice = stored.unionByName(
        stored.withColumn("embedding", F.transform("embedding", lambda x: -x))
    )
    loaded = emb.load_embeddings(bridges.reviews(spark, folder), twice)
    return rounded(loaded.select("id", F.col("embedding")[0].alias("first")), 4)


@register("union_embeddings", bridges.vectors)
def union_embeddings(df: DataFrame) -> DataFrame:
    beta, alpha = (df.where(F.col("platform") == p) for p in ("beta", "alpha"))
    both = emb.union_embeddings(beta, alpha)
    return rounded(both.select("id", F.col("embedding")[0].cast("double").alias("first")), 4)


@register("centroid", bridges.vectors)
def centroid(df: DataFrame) -> DataFrame:
    center = emb.centroid(df.where(F.col("rating") <= 3))
    return rounded(center.select(F.posexplode("centroid").alias("pos", "value")), 4)


@register("closest_to_centroid", bridges.vectors)
def closest_to_centroid(df: DataFrame) -> DataFrame:
    chosen = df.where(F.col("rating") == 7).select("id")
    return rounded(emb.closest_to_centroid(emb.l2_normalize(df), chosen, 25), 4)


@register("representatives")
def representatives(spark: SparkSession, folder: str) -> DataFrame:
    placed = emb.l2_normalize(bridges.points(spark, folder))
    # A third of the ids has no review, so some of the closest keep a row of nulls.
    reviews = bridges.reviews(spark, folder).where(F.col("id").cast("long") % 3 != 0)
    return emb.representatives(placed, reviews, filters.in_region(*REGION))


def _closest_in_cells(df: DataFrame, chosen: Column, k: int) -> DataFrame:
    """The closest rows out of all vectors stored by cell; the centre comes from the stored ones, too."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "cells")
    cells.write_cells(emb.l2_normalize(df), path)
    center = emb.centroid(spark.read.parquet(f"{path}/vectors").where(chosen)).first()
    return cells.closest_in_cells(spark, path, center and center["centroid"], k)[0]


@register("closest_to_centroid_cells", bridges.vectors)
def closest_to_centroid_cells(df: DataFrame) -> DataFrame:
    return rounded(_closest_in_cells(df, F.col("rating") == 7, 25), 4)


@register("representatives_cells")
def representatives_cells(spark: SparkSession, folder: str) -> DataFrame:
    placed = bridges.points(spark, folder)
    closest = _closest_in_cells(placed, filters.in_region(*REGION), 10)
    return emb.with_reviews(closest, bridges.reviews(spark, folder))


@register("knn_graph", bridges.vectors)
def knn_graph(df: DataFrame) -> DataFrame:
    return rounded(neighbours.knn_graph(df, k=5, block_rows=256), 4)


@register("knn_descent", bridges.vectors)
def knn_descent(df: DataFrame) -> DataFrame:
    return rounded(descent.knn_descent(df, k=5), 4)


@register("spectral_layout", bridges.vectors)
def spectral_layout(df: DataFrame) -> DataFrame:
    weights = spectral.fuzzy_weights(descent.knn_descent(df, k=10))
    return rounded(spectral.spectral_layout(weights, tolerance=1e-4), 4)


@register("text_length_summary", bridges.reviews)
def text_length_summary(df: DataFrame) -> DataFrame:
    sized = df.withColumn("chars", F.char_length("text"))
    return rounded(quantiles.six_numbers(sized, "chars", ("platform",)))


@register("text_length_quantiles", bridges.reviews)
def text_length_quantiles(df: DataFrame) -> DataFrame:
    """So few rows are counted one by one that the brackets have to be narrowed."""
    sized = df.withColumn("chars", F.char_length("text"))
    return rounded(
        quantiles.exact_quantiles(sized, "chars", [0.0, 0.1, 0.5, 0.999], ("platform", "rating"), few=20)
    )


@register("select_region", bridges.points)
def select_region(df: DataFrame) -> DataFrame:
    region = filters.select_region(df, *REGION)
    return rounded(region.select("id", "platform", "rating", "dim1", "dim2"), 4)


@register("region_summary", bridges.points)
def region_summary(df: DataFrame) -> DataFrame:
    return rounded(emb.region_summary(filters.select_region(df, *REGION)))


@register("platform_mix", bridges.points)
def platform_mix(df: DataFrame) -> DataFrame:
    return emb.platform_mix(filters.select_region(df, *REGION))


def _brushed(df: DataFrame) -> DataFrame:
    """The region's points out of a stored table of all points."""
    path = scratch_path(df.sparkSession, "points")
    regions.write_points(df.select("id", "platform", "rating", "dim1", "dim2"), path)
    return regions.read_region(df.sparkSession, path, *REGION)


@register("select_region_stored", bridges.points)
def select_region_stored(df: DataFrame) -> DataFrame:
    return rounded(_brushed(df), 4)


@register("region_summary_stored", bridges.points)
def region_summary_stored(df: DataFrame) -> DataFrame:
    return rounded(emb.region_summary(_brushed(df)))


@register("platform_mix_stored", bridges.points)
def platform_mix_stored(df: DataFrame) -> DataFrame:
    return emb.platform_mix(_brushed(df))


@register("project_pca", bridges.vectors)
def project_pca(df: DataFrame) -> DataFrame:
    return rounded(projection.project_pca(emb.l2_normalize(df)), 4)


@register("cached_projection", bridges.vectors)
def cached_projection(df: DataFrame) -> DataFrame:
    root = scratch_path(df.sparkSession, "projections")
    # Another table with as many rows comes first and must not be taken for this one.
    other = df.withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    projection.cached_projection(other, root)
    projection.cached_projection(df, root)
    return rounded(projection.cached_projection(df, root), 4)


@register("attach_projection", bridges.vectors)
def attach_projection(df: DataFrame) -> DataFrame:
    placed = df.select(
        "id",
        F.col("embedding")[0].cast("double").alias("dim1"),
        F.col("embedding")[1].cast("double").alias("dim2"),
    )
    reviews = df.select("id", "platform", "rating")
    return rounded(projection.attach_projection(reviews, placed, with_index=True), 4)


def vowel_counter():
    """An embedder plain enough for SQL: how often each vowel occurs."""
    return lambda texts: [[float(text.count(vowel)) for vowel in "aeiou"] for text in texts]


@register("embed_texts", bridges.reviews)
def embed_texts(df: DataFrame) -> DataFrame:
    vectors = emb.embed_texts(tables.load_texts(df, "text"), vowel_counter)
    names = [F.col("embedding")[i].cast("double").alias(f"n_{v}") for i, v in enumerate("aeiou")]
    return vectors.select("id", *names)


@register("embed_texts_hashed", bridges.reviews)
def embed_texts_hashed(df: DataFrame) -> DataFrame:
    vectors = emb.embed_texts(tables.load_texts(df, "text"))
    return rounded(
        vectors.select("id", F.posexplode(F.col("embedding").cast("array<double>"))), 4
    )


@register("embed_texts_semantic", bridges.reviews)
def embed_texts_semantic(df: DataFrame) -> DataFrame:
    vectors = semantic.semantic_embeddings(tables.load_texts(df, "text"), dims=8, rounds=2).vectors
    return rounded(
        vectors.select("id", F.posexplode(F.col("embedding").cast("array<double>"))), 4
    )


@register("quantize_f16", bridges.vectors)
def quantize_f16(df: DataFrame) -> DataFrame:
    halves = df.select("id", emb.quantize_f16(F.col("embedding")).alias("half"))
    flat = halves.select("id", F.posexplode("half").alias("pos", "value"))
    return flat.withColumn("value", F.col("value").cast("double"))


@register("write_embeddings", bridges.vectors)
def write_embeddings(df: DataFrame) -> DataFrame:
    path = emb.write_embeddings(df, scratch_path(df.sparkSession, "embeddings"), 64, half=False)
    stored = df.sparkSession.read.parquet(path)
    return rounded(stored.select("id", F.posexplode(F.col("embedding").cast("array<double>"))), 4)


@register("normalize_stream")
def normalize_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    source = scratch_path(spark, "stream-in")
    texts = _both_texts(spark, folder)
    texts.withColumnRenamed("text", "comment").write.parquet(source)
    schema = spark.read.parquet(source).schema
    target, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    normalize_stream(spark, source, schema, target, state, fmt="parquet", stopwords=STOPWORDS)
    return spark.read.parquet(target)
