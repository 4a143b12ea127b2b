"""Words broken into the forms of a lexicon.

For scripts that write no blanks between words, and for texts whose dictionary forms and parts of
speech a lexicon names. The lexicon is a table of any size: it is joined, never gathered. Words are
dealt into parts of a few MB; a part asks once for each form that it may hold, however many of its
words hold it, so that rows travel by part and form and not by word, place and length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.tokens import words_in
from reviewlens.operators.normalise import kept_lemmas
from reviewlens.schema import ANALYSED_TOKENS
from reviewlens.storage import stored

# The tag of what the lexicon does not know.
UNKNOWN = "UN"
# Bytes of words or texts in a part, about; code points that a task works on at a time.
PART_BYTES = 4 << 20
SLICE = 1 << 18
# Bits of the sieve: at least 16 for a form, but 2^28 in all; beyond that it only lets more through.
FORM_BITS, LEAST_BITS, MOST_BITS = 16, 16, 28
# Of the sieve of a part's own forms, and by how many fewer the list of their hashes is cut.
MOST_OWN_BITS, FEWER_BITS = 24, 3
BLOCK_BITS = 16

# Odd numbers, so that products modulo 2^64 can be undone.
BASE, MIX, SECOND = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
ASKED = "part int, hash long"
NEVER = 1 << 61
# Longer than any string; prefix_lengths of less is the beginning of its list.
ANY_LENGTH = 1 << 31


def prefix_lengths(longest: int) -> list[int]:
    """The lengths by whose beginnings forms are looked up: all up to 8, then four in each doubling."""
    out = list(range(1, min(8, longest) + 1))
    while len(out) >= 8 and (following := out[-1] + (1 << out[-1].bit_length() - 3)) <= longest:
        out.append(following)
    return out


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of ``BASE`` and what undoes them."""
    base, undo = np.full(count, BASE, np.uint64), np.full(count, pow(BASE, -1, 1 << 64), np.uint64)
    return np.cumprod(base), np.cumprod(undo)


def _utf8(texts: pa.Array) -> bytes:
    """The bytes of strings without nulls, one behind another."""
    if not len(texts):
        return b""
    _, ends, data = texts.cast(pa.string()).buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return data[ends[0] : ends[-1]].to_pybytes() if ends[-1] > ends[0] else b""


class Spelled:
    """The code points of strings one behind another, and hashes of any stretch of them."""

    def __init__(self, texts: pa.Array):
        self.utf8 = _utf8(texts)
        self.code = np.frombuffer(self.utf8.decode().encode("utf-32-le"), np.uint32)
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.left = np.repeat(self.first[1:], sizes) - np.arange(len(self.code))
        count = len(self.code) + 1
        # Of some sizes only, so that the next strings find them worked out.
        power, self.undo = _powers(1 << max(SLICE.bit_length(), (count - 1).bit_length()))
        self.sums = np.zeros(count, np.uint64)
        np.cumsum((self.code.astype(np.uint64) + np.uint64(1)) * power[: count - 1], out=self.sums[1:])

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        value = self.sums[at + length]
        value -= self.sums[at]
        value *= self.undo[at]
        value += np.uint64(length)
        value ^= value >> np.uint64(32)
        value *= np.uint64(MIX)
        value ^= value >> np.uint64(29)
        return value

    def beginnings(self, steps: list[int], sieve: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length: the places where a stretch of it passes the sieve, and the stretches' hashes."""
        at = np.arange(len(self.code))
        for length in steps:
            at = at[self.left[at] >= length]
            if not len(at):
                return
            own, hashes = at, self.hashes(at, length)
            for n in range(2):
                place = _places(hashes, bits, n)
                passed = np.flatnonzero((sieve[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                own, hashes = own[passed], hashes[passed]
            yield own, hashes


def _form_hashes(forms: Spelled, steps: list[int]) -> np.ndarray:
    """Hash of each form's longest beginning of a length in ``steps``."""
    sizes = np.diff(forms.first)
    which = np.searchsorted(steps, sizes, "right") - 1
    out = np.zeros(len(sizes), np.uint64)
    for n in np.unique(which):
        own = np.flatnonzero(which == n)
        out[own] = forms.hashes(forms.first[own], steps[n])
    return out


def _places(hashes: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first or second (0, 1) of the two bits of the sieve that stand for a hash."""
    return ((hashes * np.uint64(SECOND) if n else hashes) >> np.uint64(64 - bits)).astype(np.int64)


def _bits(forms: int, most: int) -> int:
    return min(most, max(LEAST_BITS, math.ceil(math.log2(FORM_BITS * max(forms, 1)))))


def _sliced(words: pa.Array) -> Iterator[pa.Array]:
    """The words in order, about ``SLICE`` code points at a time."""
    ends = np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(words):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield words.slice(at, end - at)
        at = end


class _Found:
    """The forms of a part by the hashes of their beginnings."""

    def __init__(self, forms: Spelled, steps: list[int]):
        self.forms, self.steps, self.size = forms, steps, np.diff(forms.first)
        hashes = _form_hashes(forms, steps)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes, self.begin = np.unique(hashes[self.order], return_index=True)
        self.count = np.diff(np.append(self.begin, len(hashes)))
        self.bits = _bits(len(hashes), MOST_OWN_BITS)
        marked = np.zeros(1 << self.bits, bool)
        for n in range(2):
            marked[_places(hashes, self.bits, n)] = True
        self.sieve = np.packbits(marked, bitorder="little")
        # For each beginning of a hash, the first hash that is not smaller; the last one ends all searches.
        starts = _places(self.hashes, self.bits - FEWER_BITS, 0)
        self.firsts = np.searchsorted(starts, np.arange(1 << self.bits - FEWER_BITS)).astype(np.int32)
        self.hashes = np.append(self.hashes, np.uint64(2**64 - 1))
        self.count, self.begin = np.append(self.count, 0), np.append(self.begin, 0)

    def edges(self, words: Spelled) -> tuple[np.ndarray, np.ndarray]:
        """(place, form) for every form found anywhere in the words, compared code point by code point."""
        places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, hashes in words.beginnings(self.steps, self.sieve, self.bits):
            row = self.firsts[_places(hashes, self.bits - FEWER_BITS, 0)]
            # Few hashes begin alike; the next one is tried where the one before was smaller.
            ahead = np.flatnonzero(self.hashes[row] < hashes)
            while len(ahead):
                row[ahead] += 1
                ahead = ahead[self.hashes[row[ahead]] < hashes[ahead]]
            same = np.flatnonzero(self.hashes[row] == hashes)
            at, row = at[same], row[same]
            count = self.count[row]
            if count.max(initial=0) > 1:
                within = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count)
                at, row = np.repeat(at, count), np.repeat(self.begin[row], count) + within
            else:
                row = self.begin[row]
            places.append(at)
            found.append(self.order[row])
        at, form = np.concatenate(places), np.concatenate(found)
        fits = self.size[form] <= words.left[at]
        at, form = at[fits], form[fits]
        # Hashes of beginnings only proposed the forms. The longest come first, so that fewer are left at each step.
        order = np.argsort(-self.size[form], kind="stable")
        at, form = at[order], form[order]
        size, start = self.size[form], self.forms.first[form]
        right = np.ones(len(at), bool)
        for place in range(int(size.max(initial=0))):
            longer = int(np.searchsorted(-size, -place, "left"))
            right[:longer] &= words.code[at[:longer] + place] == self.forms.code[start[:longer] + place]
        return at[right], form[right]


def cheapest_paths(
    words: Spelled, at: np.ndarray, form: np.ndarray, size: np.ndarray, cost: np.ndarray, unknown: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, form) of the pieces of least total cost that make up each word, in order.

    A code point without a form costs ``unknown`` and has form -1. Ties go to fewer pieces, then to the
    longer last piece. All words advance together, by the place within them from which they go on.
    """
    count = len(words.first) - 1
    # A word of n code points has n + 1 nodes, one for each place between them.
    start, end = words.first[:-1] + np.arange(count), words.first[1:] + np.arange(count)
    total = len(words.code) + count
    best, pieces = np.full(total, NEVER, np.int64), np.zeros(total, np.int64)
    chosen = np.full(total, -1, np.int64)
    best[start] = 0
    source, target = at + words.text[at], at + words.text[at] + size
    inside = at - words.first[words.text[at]]
    longest = int(np.diff(words.first).max(initial=0))
    # Small whole numbers are sorted by their digits.
    order = np.argsort(inside.astype(np.uint16) if longest <= 0xFFFF else inside, kind="stable")
    bounds = np.searchsorted(inside[order], np.arange(longest + 1))
    by_size = np.argsort(-np.diff(words.first), kind="stable")
    lasting = np.searchsorted(-np.diff(words.first)[by_size], -np.arange(longest), "left")

    def relax(source: np.ndarray, target: np.ndarray, price, edge) -> None:
        value, number = best[source] + price, pieces[source] + 1
        better = (value < best[target]) | ((value == best[target]) & (number < pieces[target]))
        target = target[better]
        best[target], pieces[target] = value[better], number[better]
        chosen[target] = edge[better] if isinstance(edge, np.ndarray) else edge

    for place in range(longest):
        here = start[by_size[: lasting[place]]] + place
        relax(here, here + 1, unknown, -1)
        edge = order[bounds[place] : bounds[place + 1]]
        relax(source[edge], target[edge], cost[edge], edge)
    word, node, out = np.flatnonzero(end > start), end[end > start], []
    while len(word):
        edge = chosen[node]
        node = np.where(edge >= 0, source[edge] if len(source) else node - 1, node - 1)
        out.append((word, node, np.where(edge >= 0, form[edge] if len(form) else -1, -1)))
        more = node > start[word]
        word, node = word[more], node[more]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    word, node, form = (np.concatenate(column) for column in zip(*out))
    order = np.argsort(node, kind="stable")
    return word[order], (node - word)[order], form[order]


def _known(lexicon: DataFrame) -> DataFrame:
    """Each form once, with the cheapest of its rows."""
    entry = F.struct(
        F.col("cost").cast("long").alias("cost"),
        F.coalesce("tag", F.lit(UNKNOWN)).alias("tag"),
        F.coalesce("lemma", F.lit("")).alias("lemma"),
    )
    once = lexicon.where("form <> '' AND cost IS NOT NULL").groupBy("form").agg(F.min(entry).alias("entry"))
    return once.select("form", "entry.cost", "entry.tag", F.nullif("entry.lemma", F.lit("")).alias("lemma"))


def _hashed(known: DataFrame, steps: list[int]) -> DataFrame:
    """The forms with the hashes by which they are asked for."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _form_hashes(Spelled(batch.column("form")), steps).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(hashes)], names=[*batch.schema.names, "hash"]
            )

    return known.mapInArrow(add, "form string, cost long, tag string, lemma string, hash long")


def _sieve(forms: DataFrame, bits: int) -> np.ndarray:
    """Bits of which two are set for each form: what has one of its two unset is none."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            both = np.unique(np.concatenate([_places(hashes, bits, n) for n in range(2)]))
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(both >> BLOCK_BITS), "place": pa.array(both % (1 << BLOCK_BITS))}
            )

    def block(group: pa.Table) -> pa.Table:
        own = np.zeros(1 << BLOCK_BITS, bool)
        own[group["place"].to_numpy()] = True
        packed = np.packbits(own, bitorder="little").tobytes()
        return pa.table({"block": group["block"].slice(0, 1), "packed": pa.array([packed], pa.binary())})

    marked = forms.select("hash").mapInArrow(places, "block long, place long")
    out = np.zeros(1 << bits - 3, np.uint8)
    size = 1 << BLOCK_BITS - 3
    for row in marked.groupBy("block").applyInArrow(block, "block long, packed binary").collect():
        out[row["block"] * size : (row["block"] + 1) * size] = np.frombuffer(row["packed"], np.uint8)
    return out


def _asking(sieve: Broadcast, bits: int, steps: list[int], column: str) -> Callable:
    """For a part: the hashes of beginnings in its words that may be those of forms, each once."""

    def ask(group: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.uint64)]
        for words in _sliced(_flat(group[column]).unique()):
            found += [np.unique(hashes) for _, hashes in Spelled(words).beginnings(steps, sieve.value, bits)]
        hashes = np.unique(np.concatenate(found)).view(np.int64)
        part = pa.array(np.full(len(hashes), group["part"][0].as_py(), np.int32))
        return pa.table({"part": part, "hash": pa.array(hashes)})

    return ask


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """A column of words, or the words of a column of lists; nulls as empty words."""
    whole = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.fill_null(whole.flatten() if pa.types.is_list(whole.type) else whole, "")


def _pieces(words: pa.Array, known: pa.Table, steps: list[int], unknown: int) -> Iterator[tuple]:
    """For slices of the words: their code points, and the (word, place, form) of the cheapest pieces."""
    found, cost = _Found(Spelled(_flat(known["form"])), steps), known["cost"].to_numpy()
    for part in _sliced(words):
        spelled = Spelled(part)
        at, form = found.edges(spelled)
        paths = cheapest_paths(spelled, at, form, found.size[form], cost[form], unknown)
        yield spelled, *paths


def _token_lists(words: pa.Array, known: pa.Table, steps: list[int], unknown: int) -> pa.ChunkedArray:
    """The tokens of each word; neighbouring unknown pieces are one."""
    tags = pa.concat_arrays([_flat(known["tag"]), pa.array([UNKNOWN])])
    lemmas = pa.concat_arrays([*known["lemma"].chunks, pa.array([None], pa.string())])
    strange = pc.equal(tags, UNKNOWN).to_numpy(zero_copy_only=False)
    lists = []
    for spelled, word, place, form in _pieces(words, known, steps, unknown):
        begins = np.ones(len(word), bool)
        begins[1:] = ~(strange[form][1:] & strange[form][:-1] & (word[1:] == word[:-1]))
        first = np.flatnonzero(begins)
        last = pa.array(form[np.append(first[1:], len(word)) - 1] % len(tags)) if len(word) else pa.array([], pa.int64())
        # The forms of all tokens, one behind another, are the words.
        width = 1 + sum((spelled.code > most).astype(np.int64) for most in (0x7F, 0x7FF, 0xFFFF))
        ends = np.concatenate([[0], np.cumsum(width)])
        offsets = np.append(ends[place[first]], len(spelled.utf8)).astype(np.int32)
        texts = [None, pa.py_buffer(offsets), pa.py_buffer(spelled.utf8)]
        columns = [pa.Array.from_buffers(pa.string(), len(first), texts), tags.take(last), lemmas.take(last)]
        bounds = np.searchsorted(word[first], np.arange(len(spelled.first))).astype(np.int32)
        structs = pa.StructArray.from_arrays(columns, ["form", "tag", "lemma"])
        lists.append(pa.ListArray.from_arrays(pa.array(bounds), structs))
    return pa.chunked_array(lists)


def _kept(words: pa.Array, known: pa.Table, steps: list[int], unknown: int) -> pa.Array:
    """The kept lemmas of each word, joined by spaces; "" is kept as the form itself."""
    lemmas, forms = (pa.concat_arrays([*known[name].chunks, pa.array([], pa.string())]) for name in ("kept", "form"))
    lemmas = pc.if_else(pc.equal(lemmas, ""), forms, lemmas)
    lemmas = pa.concat_arrays([lemmas, pa.array([None], pa.string())])
    joined = [pa.array([], pa.string())]
    for spelled, word, _, form in _pieces(words, known, steps, unknown):
        own = lemmas.take(pa.array(form % len(lemmas)))
        valid = own.is_valid().to_numpy(zero_copy_only=False)
        bounds = np.searchsorted(word[valid], np.arange(len(spelled.first))).astype(np.int32)
        joined.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds), own.drop_null()), " "))
    return pa.concat_arrays(joined)


def _dealt(df: DataFrame, size: Column, by: list[str]) -> DataFrame:
    """``df`` with the part of each row, some ``PART_BYTES`` each but enough for all tasks."""
    total = df.agg(F.sum(size)).first()[0] or 0
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(total / PART_BYTES), min(tasks, math.ceil(total / (1 << 16))))
    return df.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).repartition(parts, "part")


def _with_forms(
    parted: DataFrame, columns: list[str], lexicon: DataFrame, answer: list[Column], work: Callable, schema: str
) -> DataFrame:
    """``work`` done on each part and what ``answer`` says of the forms that may be in its words.

    The words stand in the first of the ``columns``; the others only make asking deal the same rows as
    the work, so that Spark deals them once.
    """
    spark = parted.sparkSession
    forms = stored(_hashed(_known(lexicon), prefix_lengths(ANY_LENGTH)), "lexicon")
    count, longest = forms.agg(F.count(F.lit(1)), F.max(F.char_length("form"))).first()
    steps = prefix_lengths(longest or 0)
    bits = _bits(count, MOST_BITS)
    sieve = spark.sparkContext.broadcast(_sieve(forms, bits))
    asked = parted.select("part", *columns).groupBy("part").applyInArrow(_asking(sieve, bits, steps, columns[0]), ASKED)
    found = asked.join(forms.select("hash", "form", "cost", *answer), "hash").drop("hash")

    def both(own: pa.Table, known: pa.Table) -> pa.Table:
        return work(own, known, steps)

    return parted.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(both, schema)


def break_words(words: DataFrame, lexicon: DataFrame, unknown: int = 1000) -> DataFrame:
    """(word, tokens): each distinct word, and the cheapest sequence of forms that makes it up.

    ``words``: word. ``lexicon``: form, tag, lemma (may be null), cost (a whole number, the smaller the
    likelier, below ``unknown``). Of several rows of a form the cheapest counts, then the smallest
    tag and lemma; null or empty forms and null costs stand for nothing; a null tag is UN.

    The distinct words are dealt into parts. A part asks for the beginnings, of a few lengths, at any
    place of its words, each once and only if a bit table of the lexicon does not rule it out; one join
    answers with the forms that begin so, and the rest of a form is compared in the task. So the rows
    moved grow with the distinct words and not with their places, nor with the texts. Null words are
    left out; an empty word has no tokens; without a lexicon each word is one unknown token.
    """
    distinct = stored(words.select("word").dropna().distinct(), "distinct-words")
    parted = _dealt(distinct, F.octet_length("word") + 1, ["word"])

    def work(own: pa.Table, known: pa.Table, steps: list[int]) -> pa.Table:
        each = _flat(own["word"])
        return pa.table({"word": each, "tokens": _token_lists(each, known, steps, unknown)})

    schema = f"word string, tokens {ANALYSED_TOKENS.simpleString()}"
    return _with_forms(parted, ["word"], lexicon, [F.col("tag"), F.col("lemma")], work, schema)


def normalize_by_lexicon(
    df: DataFrame,
    lexicon: DataFrame,
    text: str = "text",
    stopwords: list[str] | None = None,
    unknown: int = 1000,
) -> DataFrame:
    """``id``, the original text, and the kept lemmas of its words as the lexicon breaks them.

    As ``normalize_reviews`` with an analyser that knows the lexicon, but the texts are dealt into
    parts, and a part fetches its forms as in ``break_words`` and analyses each of its words once. Tags
    and stopwords count as there. One row per row of ``df``; a text without kept lemmas, also a null
    one, gives "".
    """
    reviews = df.select(F.col("id").cast("string").alias("id"), F.col(text).alias("original_text"))
    reviews = stored(reviews, "texts")
    parted = _dealt(reviews, F.coalesce(F.octet_length("original_text"), F.lit(0)) + 16, ["id", "original_text"])
    parted = parted.withColumn("words", words_in(parted, "original_text"))
    token = F.struct("form", "tag", "lemma")

    def work(own: pa.Table, known: pa.Table, steps: list[int]) -> pa.Table:
        words = _flat(own["words"]).dictionary_encode()
        lemmas = _kept(words.dictionary, known, steps, unknown).take(words.indices)
        said = pc.not_equal(lemmas, "").to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.list_value_length(own["words"]), 0).to_numpy()
        before = np.concatenate([[0], np.cumsum(said)])[np.concatenate([[0], np.cumsum(sizes)])]
        lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), lemmas.filter(pa.array(said)))
        return pa.table(
            {
                "id": own["id"],
                "original_text": own["original_text"],
                "normalized_text": pc.binary_join(lists, " "),
            }
        )

    schema = "id string, original_text string, normalized_text string"
    kept = F.get(kept_lemmas(F.array(token), stopwords), F.lit(0))
    kept = F.when(kept == F.col("form"), "").otherwise(kept).alias("kept")
    return _with_forms(parted, ["words", "id"], lexicon, [kept], work, schema)
