"""Words of review texts: tokens, frequencies, top lists, stopword removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.tokens import LATIN, is_wanted, not_among, words_in
from reviewlens.operators.filters import filter_rating

# Stopwords of a table that are tested within the scan: so many at most, none longer than this, in so many lists.
LISTED = 4096
LISTED_CHARS = 100
LISTS = 1024

def with_words(df: DataFrame, text: str = "text") -> DataFrame:
    """The text replaced by its array of words.

    Written to parquet once, the result serves every operator here and in ``keywords`` that takes
    a text column, and spares each of them the tokeniser.
    """
    return df.withColumn(text, words_in(df, text))


def tokenize(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per word of each text; texts without words give none."""
    return df.select(*keep, F.explode(words_in(df, text)).alias("word"))


def filter_tokens(
    tokens: DataFrame,
    min_chars: int = 1,
    char_class: str | None = None,
    stopwords: list[str] | None = None,
) -> DataFrame:
    """Words of at least ``min_chars`` characters that contain the class and are no stopword."""
    return tokens.where(is_wanted(F.col("word"), min_chars, char_class, stopwords))


def word_frequency(
    df: DataFrame,
    text: str = "text",
    min_rating: float | None = None,
    max_rating: float | None = None,
    min_chars: int = 2,
    char_class: str | None = LATIN,
    stopwords: list[str] | None = None,
    sort: bool = True,
) -> DataFrame:
    """Words and how often they occur, most frequent first and ties in word order.

    Counts are combined before the shuffle, so a word that is a third of all tokens travels as one
    row per task.
    """
    texts = filter_rating(df, min_rating, max_rating).where(F.col(text).isNotNull())
    words = filter_tokens(tokenize(texts, text, keep=()), min_chars, char_class, stopwords)
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc("word")) if sort else counts


def top_words(frequency: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words and all that tie with the last of them.

    The k-th count is found by a distributed top-k and used as a threshold: no window over the
    whole vocabulary, and ties of any number stay spread over the partitions.
    """
    last = frequency.orderBy(F.desc("n")).limit(k).agg(F.min("n"))
    return frequency.where(F.col("n") >= last.scalar())


def top_keywords(
    df: DataFrame,
    text: str = "text",
    k: int = 100,
    min_chars: int = 3,
    min_n: int = 5,
    char_class: str | None = LATIN,
    stopwords: list[str] | None = None,
) -> DataFrame:
    """The most frequent words with at least ``min_n`` occurrences, ties at rank ``k`` kept."""
    frequency = word_frequency(
        df, text, min_chars=min_chars, char_class=char_class, stopwords=stopwords, sort=False
    )
    return top_words(frequency.where(F.col("n") >= min_n), k)


def cloud_words(frequency: DataFrame, max_words: int = 200, min_freq: int = 3) -> DataFrame:
    """At most ``max_words`` words of at least ``min_freq`` occurrences; ties go by word."""
    frequent = frequency.where(F.col("n") >= min_freq)
    return frequent.orderBy(F.desc("n"), F.asc("word")).limit(max_words)


def remove_stopwords(
    df: DataFrame,
    stopwords: DataFrame | list[str],
    text: str = "text",
    output: str = "text_nostop",
    keep_empty: bool = False,
) -> DataFrame:
    """The text's words without stopwords, joined by spaces in their order.

    A review left without words is dropped, or kept with an empty text. A list is tested within the
    scan, and so is a table of few words, which is known when the query runs; a table of any other size
    is an anti join. Nulls among the stopwords stand for no word.
    """
    if isinstance(stopwords, DataFrame):
        lists = _listed(stopwords)
        few = df.where(lists.isNotNull()).withColumn("stopword_lists", lists)
        words = F.filter(words_in(df, text), lambda word: ~_in_lists(F.col("stopword_lists"), word))
        tested = _joined(few.withColumn(output, F.array_join(words, " ")), output, keep_empty).drop("stopword_lists")
        return tested.unionByName(_remove_by_join(df.where(lists.isNull()), stopwords, text, output, keep_empty))
    words = F.filter(words_in(df, text), lambda word: not_among(word, stopwords))
    return _joined(df.withColumn(output, F.array_join(words, " ")), output, keep_empty)


def _joined(cleaned: DataFrame, output: str, keep_empty: bool) -> DataFrame:
    if keep_empty:
        return cleaned.withColumn(output, F.coalesce(output, F.lit("")))
    return cleaned.where(F.col(output) != "")


def _list_of(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(LISTS)).cast("int")


def _in_lists(lists: Column, word: Column) -> Column:
    return F.array_contains(F.get(lists, _list_of(word)), word)


def _listed(stopwords: DataFrame) -> Column:
    """The words dealt into lists by their hash, as one value; null if they are too many or too long."""
    words = stopwords.select("word").where("word IS NOT NULL").distinct().limit(LISTED + 1)
    short = F.char_length("word") <= LISTED_CHARS
    dealt = words.groupBy(_list_of(F.col("word")).alias("list")).agg(
        F.collect_list(F.when(short, F.col("word"))).alias("words"), F.count(F.lit(1)).alias("n"), F.count_if(~short).alias("long")
    )
    whole = dealt.agg(
        F.map_from_entries(F.collect_list(F.struct("list", "words"))).alias("lists"),
        (F.coalesce(F.sum("n"), F.lit(0)) > LISTED).alias("many"),
        (F.coalesce(F.sum("long"), F.lit(0)) > 0).alias("long"),
    )
    none = F.array().cast("array<string>")
    lists = F.transform(F.sequence(F.lit(0), F.lit(LISTS - 1)), lambda k: F.coalesce(F.col("lists")[k], none))
    return whole.select(F.when(~F.col("many") & ~F.col("long"), lists)).scalar()


def _remove_by_join(
    df: DataFrame, stopwords: DataFrame, text: str, output: str, keep_empty: bool
) -> DataFrame:
    """As ``remove_stopwords`` for a table of words.

    A digest stands for the text, so that words do not drag it through the shuffle; equal texts
    have equal digests and words, and fall together before they are shuffled. Only the words of one
    text are ever brought together.
    """
    content = F.col(text) if dict(df.dtypes)[text] == "string" else F.to_json(text)
    keyed = df.withColumn("text_key", F.unhex(F.sha2(content, 256)))
    words = keyed.select("text_key", F.posexplode(words_in(df, text)).alias("pos", "word")).join(
        stopwords.select("word").distinct(), "word", "left_anti"
    )
    ordered = F.array_sort(F.collect_set(F.struct("pos", "word")))
    cleaned = words.groupBy("text_key").agg(
        F.array_join(F.transform(ordered, lambda item: item["word"]), " ").alias(output)
    )
    joined = keyed.join(cleaned, "text_key", "left" if keep_empty else "inner").drop("text_key")
    return joined.withColumn(output, F.coalesce(output, F.lit(""))) if keep_empty else joined
