"""Scalar column expressions: casts, calendar, strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Time units and the Spark truncation each one means. Weeks start on Monday.
PERIOD_UNITS = {"day": None, "week": "week", "month": "month", "quarter": "quarter"}


def to_date(value: Column) -> Column:
    """Date, or null when the text holds none; ``2020-01-05`` and ``2020/01/05`` are read."""
    return F.coalesce(
        value.try_cast("date"), F.try_to_date(value.cast("string"), "yyyy/M/d")
    )


def crawl_date(value: Column) -> Column:
    """As ``to_date``, plus the compact and dotted forms found in page attributes."""
    stripped = strip(value)
    return F.coalesce(
        to_date(stripped),
        F.try_to_date(stripped, "yyyyMMdd"),
        F.try_to_date(F.rtrim(stripped, F.lit(".")), "yyyy.M.d"),
    )


def to_number(value: Column) -> Column:
    """Double, or null when the text is no number."""
    return value.try_cast("double")


def to_whole(value: Column) -> Column:
    """Integer part, truncated toward zero; null when out of range."""
    return value.try_cast("int")


def floor_period(date: Column, unit: str) -> Column:
    """First day of the period the date falls in."""
    if unit not in PERIOD_UNITS:
        raise ValueError(f"unit must be one of {sorted(PERIOD_UNITS)}, not {unit!r}")
    truncation = PERIOD_UNITS[unit]
    return date if truncation is None else F.trunc(date, truncation)


def rating_level(rating: Column, fractional: str = "null") -> Column:
    """Rating as a level 1..10; anything else becomes the null level.

    A fractional rating is no level (``"null"``) or loses its fraction first (``"truncate"``).
    """
    whole = to_whole(rating)
    inside = whole.between(1, 10)
    if fractional == "truncate":
        return F.when(inside, whole)
    if fractional == "null":
        return F.when(inside & (whole == rating), whole)
    raise ValueError("fractional must be 'null' or 'truncate'")


def strip(text: Column) -> Column:
    """Whitespace of any kind removed from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def collapse_whitespace(text: Column) -> Column:
    """Every run of whitespace becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x0b\x1c-\x1f\x85\p{Z}]+", " "))


def truncate_text(text: Column, width: int = 120) -> Column:
    """At most ``width`` characters, the closing ``...`` included."""
    return F.when(
        F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))
    ).otherwise(text)


def last_integer(text: Column) -> Column:
    """The last run of digits in the text, or an empty string."""
    return F.coalesce(
        F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)),
        F.lit(""),
    )


def title_key(title: Column, suffix: str = "") -> Column:
    """File-safe key: spaces become underscores, characters no file name may hold go."""
    return F.concat(F.translate(title, ' \\/*?:"<>|', "_"), F.lit(suffix))


def before_dash(text: Column) -> Column:
    return F.trim(F.split(text, "-").getItem(0))


def axis_break(span_days: Column) -> Column:
    """Axis spacing for a span of days; a month counts 30.4 days."""
    months = span_days / F.lit(30.4)
    return (
        F.when(months <= 6, "1 month")
        .when(months <= 18, "3 months")
        .when(months <= 36, "6 months")
        .when(months.isNotNull(), "1 year")
    )
