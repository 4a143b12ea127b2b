"""Part-of-speech filtered lemmas of a review text, with a pluggable analyser."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.scalars import strip
from reviewlens.functions.tokens import not_among
from reviewlens.functions.wordlists import KEPT_TAGS, NORMALISER_STOPWORDS
from reviewlens.schema import ANALYSED_TOKENS

# text -> [(form, tag, lemma or None)]
Analyser = Callable[[str], list[tuple[str, str, str | None]]]

# Runs of letters and of numbers that are no decimal digits.
_NOUN = r"[\p{L}\p{Nl}\p{No}]+"


def simple_analyser() -> Analyser:
    """Stand-in for a morphological analyser: words are nouns, numbers SN, the rest symbols."""
    pattern = re.compile(r"(?P<NNG>[^\W\d_]+)|(?P<SN>\d+)|(?P<SW>[^\w\s]|_)")

    def analyse(text: str) -> list[tuple[str, str, str | None]]:
        return [(found[0], found.lastgroup, None) for found in pattern.finditer(text)]

    return analyse


# Texts whose tokens are held at a time by a Python analyser: so many, and fewer of more bytes.
ANALYSED_TEXTS = 256
ANALYSED_BYTES = 1 << 20


def simple_tokens(text: Column) -> Column:
    """What ``simple_analyser`` finds, as an expression of the JVM."""
    forms = F.regexp_extract_all(
        F.coalesce(text, F.lit("")), F.lit(rf"{_NOUN}|\p{{Nd}}+|[^\s\p{{Z}}]"), F.lit(0)
    )
    tag = (
        lambda form: F.when(form.rlike(rf"^{_NOUN}"), "NNG")
        .when(form.rlike(r"^\p{Nd}"), "SN")
        .otherwise("SW")
    )
    return F.transform(
        forms,
        lambda form: F.struct(
            form.alias("form"), tag(form).alias("tag"), F.lit(None).cast("string").alias("lemma")
        ),
    )


def analyse(text: Column, make_analyser: Callable[[], Analyser] | None = None) -> Column:
    """The analysed tokens of a text, by the plain stand-in unless an analyser is given.

    A given analyser is made once per task, not per row.
    """
    if make_analyser is None:
        return simple_tokens(text)

    @F.arrow_udf(ANALYSED_TOKENS)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        analyser = make_analyser()
        for batch in batches:
            parts = [
                _token_lists([analyser(review or "") for review in part.to_pylist()])
                for part in _slices(batch)
            ]
            yield pa.concat_arrays(parts) if parts else _token_lists([])

    return tokens(text)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """At most ``ANALYSED_TEXTS`` texts at a time, and a few of ``ANALYSED_BYTES`` if they are long."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        most = (ends[at - 1] if at else 0) + ANALYSED_BYTES
        end = min(max(at + 1, int(np.searchsorted(ends, most, "right"))), at + ANALYSED_TEXTS)
        yield texts.slice(at, end - at)
        at = end


def _analysed(texts: DataFrame, make_analyser: Callable[[], Analyser]) -> DataFrame:
    """(id, original_text, tokens) by an analyser made once per task.

    Tokens take many times the room of their text, so they leave the task slice by slice; a column's
    function would have to hold those of a whole batch of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = make_analyser()
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                tokens = _token_lists([analyser(review or "") for review in part.to_pylist()])
                columns = [batch.column(0).slice(at, len(part)), part, tokens]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "original_text", "tokens"])
                at += len(part)

    schema = f"id string, original_text string, tokens {ANALYSED_TOKENS.simpleString()}"
    return texts.mapInArrow(run, schema)


def _token_lists(analysed: list[list[tuple[str, str, str | None]]]) -> pa.Array:
    """One list of tokens per text, as Arrow."""
    offsets = np.cumsum([0, *map(len, analysed)], dtype=np.int32)
    flat = [token for found in analysed for token in found]
    columns = [pa.array([token[i] for token in flat], pa.string()) for i in range(3)]
    structs = pa.StructArray.from_arrays(columns, ["form", "tag", "lemma"])
    return pa.ListArray.from_arrays(pa.array(offsets), structs)


def kept_lemmas(tokens: Column, stopwords: list[str] | None = None) -> Column:
    """Lemmas, or forms where there is none, of the content words that are no stopword."""
    stopwords = NORMALISER_STOPWORDS if stopwords is None else stopwords
    content = F.filter(tokens, lambda token: token["tag"].rlike(f"^({'|'.join(KEPT_TAGS)})"))
    lemmas = F.transform(
        content,
        lambda token: strip(F.coalesce(F.nullif(token["lemma"], F.lit("")), token["form"])),
    )

    def wanted(lemma: Column) -> Column:
        return (lemma != "") & not_among(lemma, stopwords)

    return F.filter(lemmas, wanted)


def normalize_reviews(
    df: DataFrame,
    text: str = "text",
    make_analyser: Callable[[], Analyser] | None = None,
    stopwords: list[str] | None = None,
) -> DataFrame:
    """``id``, the original text, and its kept lemmas joined by spaces; empty ones stay as ""."""
    texts = df.select(F.col("id").cast("string").alias("id"), F.col(text).alias("original_text"))
    if make_analyser is None:
        analysed = texts.withColumn("tokens", simple_tokens(F.col("original_text")))
    else:
        analysed = _analysed(texts, make_analyser)
    normalized = F.array_join(kept_lemmas(F.col("tokens"), stopwords), " ")
    return analysed.select("id", "original_text", normalized.alias("normalized_text"))
