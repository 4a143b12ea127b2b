from datetime import date

import pytest
from pyspark.sql import functions as F

from reviewlens.functions import scalars
from reviewlens.sources import pages, tables
from reviewlens.streaming.normalise import normalize_stream

ARTICLES = """<html><title>Some - Film</title><script>var t = '<article class="user-review-item">';
</script><!-- <h2 data-testid="subtitle">no</h2> -->
<h2 data-testid="subtitle">Some: Film?</h2>
<article class="user-review-item"><span aria-label="ann's rating: 8"></span>
 <div data-testid="reviews-author"><a data-testid="author-link">ann b</a></div>
 <h3>Not this</h3><div data-testid="review-summary"><h3>Great <b>one</b></h3></div>
 <div data-testid="review-overflow">Loved   it <br>a <div>lot &amp; more</div> then</div> after
</article>
<article class="x user-review-item y"><span aria-label="bob's rating: 10"></span><h3>T2</h3>
 <div data-testid="review-overflow">ok</div></article>
<article class="user-review-item"><h3>No text</h3></article>
<article class="other-user-review-item"><h3>Other</h3><p data-testid="review-overflow">no</p></article>
<article class="user-review-item"><div data-testid="review-overflow">last</div></article>
<footer><h3>Footer</h3></footer></html>"""

CARDS = """<div class="title_area type_keep _title_area"><span class="area_text_title">
<strong class="_text"> 기생충 </strong></span></div>
<ul class="area_card_outer _item_wrapper">
<li class="area_card _item" data-report-writer-id="kim1" data-report-time="20200105" data-report-title="재밌다">
 <div class="area_title_box"><div class="area_text_box">별점(10점 만점 중) 9</div></div>
 <button class="area_button_upvote"><span class="this_text_number _count_num">3</span></button></li>
<li class="area_card _item" data-report-writer-id="lee">
 <div class="area_review_content"><span class="desc_text">길다
 글</span></div>
 <button class="area_button_downvote x"><span class="_count_num this_text_number">1</span></button></li>
<li class="area_card">no</li></ul>"""


def page(spark, html):
    return spark.createDataFrame([(7, html)], "page_id int, html string")


def test_articles(spark):
    rows = pages.extract_article_reviews(page(spark, ARTICLES)).collect()
    assert [tuple(row) for row in rows] == [
        (7, "ann b", "Greatone", "8", "Loved it a lot & more then"),
        (7, "bob", "T2", "10", "ok"),
        (7, "", "", "", "last"),
    ]
    article = (
        '<article class="user-review-item"><h3>T</h3><div data-testid="review-overflow">x</div></article>'
    )
    assert pages.extract_article_reviews(page(spark, article * 700)).count() == 700
    assert pages.extract_article_reviews(page(spark, ARTICLES), drop_empty=False).count() == 4
    assert pages.extract_article_reviews(page(spark, None)).count() == 0


def test_cards(spark):
    rows = pages.extract_card_reviews(page(spark, CARDS)).collect()
    assert [tuple(row) for row in rows] == [
        (7, "kim1", "9", "재밌다", "20200105", "3", ""),
        (7, "lee", "", "길다 글", "", "", "1"),
    ]


def test_quoted_markup_in_attributes(spark):
    html = """<li data-class="x" data-report-title="a <b> is > c &lt;3 class='no'"
      CLASS='_item  area_card'></li><LI class="area_card _item" data-report-title=b>
      <li class="area_cards _item"></li><li class="_item" title="area_card"></li>"""
    rows = pages.extract_card_reviews(page(spark, html)).collect()
    assert [row.text for row in rows] == ["a <b> is > c <3 class='no'", "b"]


@pytest.mark.parametrize(
    ("html", "title"),
    [
        (ARTICLES, "Some: Film?"),
        ('<h1 data-testid="hero-title-block__title">The <i>One</i></h1>', "The One"),
        ("<title>A film &amp; more - Site - x</title>", "A film & more"),
        ("<p>none</p>", ""),
        (None, ""),
    ],
)
def test_page_title(spark, html, title):
    assert pages.extract_page_title(page(spark, html)).first().title == title


def test_card_page_title(spark):
    assert pages.extract_page_title(page(spark, CARDS), "card").first().title == "기생충"
    with pytest.raises(ValueError):
        pages.extract_page_title(page(spark, CARDS), "list")


def test_broken_markup(spark):
    endless = '<li class="area_card _item"><b title="' + "a " * 20_000
    rows = pages.extract_card_reviews(page(spark, endless)).collect()
    assert [(row.writer_id, row.text) for row in rows] == [("", "")]
    unclosed = (
        '<li class="area_card _item"><div class="area_review_content"><p><span class="desc_text">a'
        '<br>b &eacute;<i>c</div> d<li class="area_card _item" data-report-title="e">'
    )
    rows = pages.extract_card_reviews(page(spark, unclosed)).collect()
    assert [row.text for row in rows] == ["a b é c", "e"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_scalars(spark):
    def lit(x):
        return F.lit(x)

    assert value(spark, scalars.title_key(lit('A: b/c? "d"|'), "_x.csv")) == "A_bc_d_x.csv"
    assert value(spark, scalars.truncate_text(lit("a" * 120))) == "a" * 120
    assert value(spark, scalars.truncate_text(lit("a" * 121))) == "a" * 117 + "..."
    assert value(spark, scalars.last_integer(lit("10 of 9"))) == "9"
    assert value(spark, scalars.last_integer(lit("none"))) == ""
    assert value(spark, scalars.strip(lit("　 a b\x85\n"))) == "a b"
    assert value(spark, scalars.collapse_whitespace(lit(" a \n b "))) == "a b"
    assert value(spark, scalars.to_date(lit("2020/1/5"))) == date(2020, 1, 5)
    assert value(spark, scalars.to_date(lit("soon"))) is None
    assert value(spark, scalars.crawl_date(lit(" 2020.1.5. "))) == date(2020, 1, 5)
    assert value(spark, scalars.to_number(lit("7.x"))) is None
    assert value(spark, scalars.to_whole(lit(-7.9))) == -7


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "in.csv").write_text(
        '﻿id,date,star_rating,content\n'
        '1,2020-01-05,8,"two\nlines, ""quoted"""\n'
        "2,NA,,plain\n"
        "3,soon,many,NA\n",
        encoding="utf-8",
    )
    raw = tables.read_reviews_csv(spark, str(tmp_path / "in.csv"))
    assert raw.columns == ["id", "date", "star_rating", "content"]
    rows = tables.harmonise_reviews(raw, "alpha").collect()
    assert [tuple(row) for row in rows] == [
        ("1", "alpha", date(2020, 1, 5), 8.0, 'two\nlines, "quoted"', None, None),
        ("2", "alpha", None, None, "plain", None, None),
        ("3", "alpha", None, None, None, None, None),
    ]


def test_round_trip_and_empty_sink(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", 'a "b"\nc\\', "k"), ("2", None, "k")], "id string, text string, title_key string"
    )
    path = tables.write_reviews(df, str(tmp_path / "out"))
    back = tables.read_reviews_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    tables.write_reviews(df, str(tmp_path / "parts"), "parquet", ["title_key"])
    assert (tmp_path / "parts" / "title_key=k").is_dir()
    with pytest.raises(ValueError):
        tables.write_reviews(df.limit(0), str(tmp_path / "none"))


def test_union_fills_missing_columns(spark):
    left = spark.createDataFrame([("1", "a")], "id string, text string")
    right = spark.createDataFrame([("1", 3)], "id string, upvote int")
    united = tables.union_reviews(left, right, left)
    assert united.columns == ["id", "text", "upvote"] and united.count() == 3


def test_standardise_crawl(spark):
    columns = ["작성자ID", "별점", "내용", "작성일자", "공감수", "비공감수"]
    rows = [("k", "9", "글", "20200105", "3", ""), ("k", "x", "글", "", "", "2")]
    schema = ", ".join(f"`{c}` string" for c in columns)
    crawl = spark.createDataFrame([*rows, rows[0]], schema)
    result = tables.standardise_crawl(crawl, "beta", "card").collect()
    assert [tuple(r)[1:8] for r in result[:2]] == [
        ("beta", date(2020, 1, 5), 9.0, "글", 3, None, "k"),
        ("beta", None, None, "글", None, 2, "k"),
    ]
    assert result[0].id == result[2].id != result[1].id
    article = spark.createDataFrame(
        [("a", "t", "8", "x")], "`작성자` string, `제목` string, `별점` string, `내용` string"
    )
    row = tables.standardise_crawl(article, "alpha", "article").first()
    assert (row.author, row.title, row.rating, row.text, row.date) == ("a", "t", 8.0, "x", None)
    with pytest.raises(ValueError):
        tables.standardise_crawl(article, "alpha", "table")


def test_text_columns(spark):
    df = spark.createDataFrame([(1, "r", "c")], "id int, review string, comment string")
    assert tuple(tables.select_text_column(df).first()) == ("1", "c")
    with pytest.raises(ValueError):
        tables.select_text_column(df.drop("id"))
    with pytest.raises(ValueError):
        tables.select_text_column(df.select("id"))
    texts = spark.createDataFrame([(1, " a "), (2, "　"), (3, None)], "id int, t string")
    assert [tuple(r) for r in tables.load_texts(texts, "t").collect()] == [("1", "a")]


def test_merge_normalized_keeps_all_reviews(spark):
    raw = spark.createDataFrame([(1, 5.0), (2, 6.0)], "id int, rating double")
    normalized = spark.createDataFrame(
        [("1", "o", "n")], "id string, original_text string, normalized_text string"
    )
    merged = tables.merge_normalized(raw, normalized)
    assert sorted(map(tuple, merged.collect())) == [("1", 5.0, "o", "n"), ("2", 6.0, None, None)]


def test_stream_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = spark.createDataFrame([], "id string, comment string").schema
    arguments = (str(source), schema, str(tmp_path / "out"), str(tmp_path / "state"))

    def texts():
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((row.id, row.original_text, row.normalized_text) for row in rows)

    (source / "1.csv").write_text('id,comment\n1,"good, film\n!"\n', encoding="utf-8")
    normalize_stream(spark, *arguments, stopwords=["film"])
    assert texts() == [("1", "good, film\n!", "good")]
    (source / "2.csv").write_text("id,comment\n2,bad 10\n3,\n", encoding="utf-8")
    normalize_stream(spark, *arguments, stopwords=["film"])
    assert texts() == [("1", "good, film\n!", "good"), ("2", "bad 10", "bad"), ("3", None, "")]
    tables.write_normalized(spark.read.parquet(str(tmp_path / "out")), str(tmp_path / "csv"))
    assert tables.read_reviews_csv(spark, str(tmp_path / "csv")).count() == 3


def test_sinks_keep_blanks_at_the_ends(spark, tmp_path):
    rows = [("1", "  lead and trail  ", "   ", None), ("2", "\ttab\t", " x", " ")]
    df = spark.createDataFrame(rows, "id string, text string, original_text string, normalized_text string")
    path = tables.write_reviews(df, str(tmp_path / "reviews"))
    assert sorted(map(tuple, tables.read_reviews_csv(spark, path).collect())) == rows
    path = tables.write_normalized(df, str(tmp_path / "normalized"))
    back = sorted(map(tuple, tables.read_reviews_csv(spark, path).collect()))
    assert back == [(r[0], r[2], r[3]) for r in rows]


def test_titles_are_decoded(spark):
    html = "<title>Caf&eacute; &#8217;s &#x27;x&#x27; &amp;lt; - Site</title>"
    assert pages.extract_page_title(page(spark, html)).first().title == "Café ’s 'x' &lt;"


def test_dates_keep_their_type(spark):
    raw = spark.createDataFrame([("1", "2020-01-05", "7", "t")], "id string, date string, star_rating string, content string")
    assert dict(tables.harmonise_reviews(raw, "alpha").dtypes)["date"] == "date"
