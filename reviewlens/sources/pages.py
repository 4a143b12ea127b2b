"""Review rows and titles from saved HTML pages.

A page is cut at the opening tags of its reviews in the JVM, which spreads one page's reviews over
rows; the few elements of each review are then looked up by an index of a whole Arrow batch's tags.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.scalars import (
    before_dash,
    collapse_whitespace,
    last_integer,
    strip,
)
from reviewlens.sources.markup import Fields
from reviewlens.sources.tagindex import IndexedFields

# Elements, attributes and patterns of the two page layouts. A selector is a chain
# of steps from outer to inner element; a step is a tag (or None) and its required attributes,
# where ``class`` lists class names and ``*`` marks a part of the value.
ARTICLE_CLASSES = ["user-review-item"]
ARTICLE_FIELDS = {
    "aria": ("aria-label", [("span", {"aria-label*": "rating:"})]),
    "link": (
        "text",
        [("div", {"data-testid": "reviews-author"}), ("a", {"data-testid": "author-link"})],
    ),
    "summary": ("text", [(None, {"data-testid": "review-summary"}), ("h3", {})]),
    "heading": ("text", [("h3", {})]),
    "body": ("words", [(None, {"data-testid": "review-overflow"})]),
}
ARIA_PATTERN = r"^(.*?)'s rating:\s*([0-9]+)"

CARD_CLASSES = ["area_card", "_item"]
CARD_FIELDS = {
    "writer_id": ("data-report-writer-id", []),
    "date": ("data-report-time", []),
    "report": ("data-report-title", []),
    "desc": (
        "words",
        [("div", {"class": "area_review_content"}), ("span", {"class": "desc_text"})],
    ),
    "box": ("words", [("div", {"class": "area_title_box"}), ("div", {"class": "area_text_box"})]),
    "up": (
        "words",
        [
            ("button", {"class": "area_button_upvote"}),
            ("span", {"class": "this_text_number _count_num"}),
        ],
    ),
    "down": (
        "words",
        [
            ("button", {"class": "area_button_downvote"}),
            ("span", {"class": "this_text_number _count_num"}),
        ],
    ),
}
CARD_TITLE = {
    "title": (
        "words",
        [
            ("div", {"class": "title_area type_keep _title_area"}),
            ("span", {"class": "area_text_title"}),
            ("strong", {"class": "_text"}),
        ],
    ),
}
TITLE_ELEMENTS = [("h2", "subtitle"), ("h1", "hero-title-block__title")]


def extract_article_reviews(
    pages: DataFrame, html: str = "html", drop_empty: bool = True
) -> DataFrame:
    """Author, title, rating and text of every review article, all strings, "" when missing."""
    found = _review_fields(pages, "article", ARTICLE_CLASSES, ARTICLE_FIELDS, html)
    aria = F.coalesce(F.col("field.aria"), F.lit(""))
    from_aria = strip(F.regexp_extract(aria, ARIA_PATTERN, 1))
    rows = found.select(
        *[c for c in pages.columns if c != html],
        F.coalesce("field.link", from_aria).alias("author"),
        F.coalesce("field.summary", "field.heading", F.lit("")).alias("title"),
        F.regexp_extract(aria, ARIA_PATTERN, 2).alias("rating"),
        F.coalesce("field.body", F.lit("")).alias("text"),
    )
    return rows.where(F.col("text") != "") if drop_empty else rows


def extract_card_reviews(
    pages: DataFrame, html: str = "html", drop_empty: bool = False
) -> DataFrame:
    """Writer, star, text, date and votes of each review card, all strings, "" when missing."""
    found = _review_fields(pages, "li", CARD_CLASSES, CARD_FIELDS, html)

    def field(name: str) -> Column:
        return F.coalesce(F.col(f"field.{name}"), F.lit(""))

    rows = found.select(
        *[c for c in pages.columns if c != html],
        field("writer_id").alias("writer_id"),
        last_integer(field("box")).alias("star"),
        F.when(field("report") != "", field("report")).otherwise(field("desc")).alias("text"),
        field("date").alias("date"),
        field("up").alias("up"),
        field("down").alias("down"),
    )
    return rows.where(F.col("text") != "") if drop_empty else rows


def extract_page_title(pages: DataFrame, layout: str = "article", html: str = "html") -> DataFrame:
    """Adds ``title``: the layout's title element, else what stands before the first dash."""
    if layout == "card":
        reader = _page_reader(CARD_TITLE)
        title = F.coalesce(reader(_without_scripts(F.col(html))).getField("title"), F.lit(""))
    elif layout == "article":
        page = _without_scripts(F.col(html))
        candidates = [
            _element_text(page, rf'<{tag}\b[^>]*\bdata-testid\s*=\s*["\']{testid}["\'][^>]*>', tag)
            for tag, testid in TITLE_ELEMENTS
        ]
        candidates.append(before_dash(_element_text(page, r"<title\b[^>]*>", "title")))
        title = F.coalesce(*candidates, F.lit(""))
    else:
        raise ValueError("layout must be 'article' or 'card'")
    return pages.withColumn("title", title)


def _element_text(page: Column, opening: str, tag: str) -> Column:
    """Text of the first such element, null when the page has none."""
    inner = F.try_element_at(
        F.regexp_extract_all(page, F.lit(rf"(?is){opening}(.*?)</{tag}\s*>"), F.lit(1)), F.lit(1)
    )
    return collapse_whitespace(decoded(F.regexp_replace(inner, "<[^>]*>", "")))


def decoded(text: Column) -> Column:
    """All named and numeric character references decoded, once; for short texts such as titles."""

    @F.pandas_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(unescape, na_action="ignore").astype(object)

    return decode(text)


def _without_scripts(html: Column) -> Column:
    """The page without comments, scripts and styles, whose content is no markup."""
    return F.regexp_replace(
        html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", ""
    )


def _review_fields(
    pages: DataFrame,
    tag: str,
    classes: list[str],
    fields: dict,
    html: str,
) -> DataFrame:
    """One row per review element of each page, with a ``field`` struct of the values found."""
    opening = _opening_tag(tag, classes)
    pieces = F.split(_without_scripts(F.col(html)), f"(?={opening})")
    # The piece before the first opening tag is the page head, unless the page starts with a review.
    reviews = F.filter(pieces, lambda piece: piece.rlike(f"^{opening}"))
    keep = [c for c in pages.columns if c != html]
    exploded = pages.select(*keep, F.explode(reviews).alias("fragment"))
    return exploded.select(*keep, _field_reader(fields)(F.col("fragment")).alias("field"))


def _opening_tag(tag: str, classes: list[str]) -> str:
    """Pattern of the start of an opening tag that has all the classes.

    Quoted values are stepped over as a whole, so that they may hold any character.
    """
    up_to_class = r"""(?:[^>"'\s]++|\s(?!(?i:class)\s*=)|"[^"]*+"|'[^']*+')*+\s(?i:class)\s*=\s*"""
    has_classes = "".join(
        rf"""(?={up_to_class}(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?'"""
        rf"""|{name}(?=[\s>])))"""
        for name in classes
    )
    return rf"<(?i:{tag})(?=\s){has_classes}"


def _field_reader(fields: dict):
    """The fields of pieces that each begin with a review's opening tag, a batch at a time."""
    schema = ", ".join(f"{name}: string" for name in fields)

    @F.arrow_udf(f"struct<{schema}>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        wanted = IndexedFields(fields)
        for batch in batches:
            found = wanted.values(batch)
            columns = [pa.array(found[name], pa.string()) for name in fields]
            yield pa.StructArray.from_arrays(columns, names=list(fields))

    return read


def _page_reader(fields: dict):
    """The fields of whole pages, one at a time."""
    schema = ", ".join(f"{name}: string" for name in fields)

    @F.pandas_udf(f"struct<{schema}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        wanted = Fields(fields)
        for batch in batches:
            found = [wanted.first_values(page, one_root=False) for page in batch]
            yield pd.DataFrame(found, columns=list(fields), dtype=object)

    return read
