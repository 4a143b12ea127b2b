"""Word tokenisation as one regular expression, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words after Unicode word breaking: runs of letters, digits and underscores with at least one
# letter or digit, or several underscores. An apostrophe, full stop or middle dot joins letters on
# both its sides; an apostrophe, full stop, comma or semicolon joins digits. The quantifiers are
# possessive, so a token of any length is matched without recursion or backtracking.
_LETTERS = r"[\p{L}\p{M}\p{Nl}]++"
_DIGITS = r"\p{Nd}++"
_RUN = rf"{_LETTERS}(?:['‘’.·]{_LETTERS})*+|{_DIGITS}(?:['‘’.,;]{_DIGITS})*+"
WORD_PATTERN = rf"_*+(?:{_RUN})(?:{_RUN}|_)*+|__++"

# A word must contain one of these to count as belonging to the script.
LATIN = "[a-z]"
HANGUL = "[가-힣]"


def word_array(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def words_in(df: DataFrame, name: str) -> Column:
    """The words of a text column; a column that holds the word array already is taken as it is."""
    column = F.col(name)
    return column if dict(df.dtypes)[name] == "array<string>" else word_array(column)


def not_among(word: Column, stopwords: list[str | None] | None) -> Column:
    """Whether a word is none of the listed ones; a null in the list stands for no word."""
    known = [listed for listed in stopwords or [] if listed is not None]
    return ~word.isin(known) if known else word.isNotNull()


def is_wanted(
    word: Column,
    min_chars: int = 1,
    char_class: str | None = None,
    stopwords: list[str] | None = None,
) -> Column:
    """Length, script and stopword tests on one word; a null or empty list tests nothing."""
    keep = F.length(word) >= min_chars
    if char_class:
        keep = keep & word.rlike(char_class)
    return keep & not_among(word, stopwords) if stopwords else keep
