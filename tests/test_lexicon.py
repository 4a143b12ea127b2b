"""Words broken by a lexicon, against all ways to break them."""

import random
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlens.operators.lexicon import (
    LEAST_BITS,
    UNKNOWN,
    Spelled,
    _asking,
    _Found,
    _hashed,
    _sieve,
    break_words,
    normalize_by_lexicon,
    prefix_lengths,
)

LEXICON = "form string, tag string, lemma string, cost long"


def brute_force(word, costs, unknown):
    """The least (cost, pieces) over all ways to cut a word, and all token lists that reach it."""
    ways = []
    for n in range(len(word)):
        for cuts in combinations(range(1, len(word)), n):
            edges = [0, *cuts, len(word)]
            pieces = [word[a:b] for a, b in zip(edges, edges[1:])]
            if all(p in costs or len(p) == 1 for p in pieces):
                ways.append((sum(costs.get(p, unknown) for p in pieces), len(pieces), pieces))
    least = min(way[:2] for way in ways)
    return [merged(way[2], costs) for way in ways if way[:2] == least]


def merged(pieces, costs):
    out = []
    for piece in pieces:
        tag = "NNG" if piece in costs else UNKNOWN
        if tag == UNKNOWN and out and out[-1][1] == UNKNOWN:
            out[-1] = (out[-1][0] + piece, UNKNOWN)
        else:
            out.append((piece, tag))
    return out


def tokens_of(rows):
    return {row.word: [(t.form, t.tag) for t in row.tokens] for row in rows}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_all_ways(spark, seed):
    draw = random.Random(seed)
    costs = {"".join(draw.choices("ab영", k=draw.randint(1, 4))): draw.randint(1, 9) for _ in range(9)}
    words = ["".join(draw.choices("ab영x", k=draw.randint(1, 9))) for _ in range(120)]
    lexicon = spark.createDataFrame([(f, "NNG", None, c) for f, c in costs.items()], LEXICON)
    table = spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string")
    found = tokens_of(break_words(table, lexicon, unknown=10).collect())
    assert set(found) == set(words)
    for word in words:
        assert found[word] in brute_force(word, costs, 10)


def test_ties_repeats_nulls_and_empty_tables(spark):
    words = spark.createDataFrame([("abab",), ("abab",), ("",), (None,), ("xyab",), ("abc",)], "word string")
    rows = [
        ("ab", "NNG", None, 2), ("ab", "VV", "abby", 1), ("abab", "NNG", None, 2), ("aba", "NNG", None, 1),
        ("b", "NNG", None, 1), ("", "NNG", None, 1), (None, "NNG", None, 1), ("xy", "NNG", None, None),
        ("bc", None, None, 1), ("a", "NNG", None, 0),
    ]
    found = tokens_of(break_words(words, spark.createDataFrame(rows, LEXICON), unknown=10).collect())
    # abab: ab+ab, aba+b, abab cost 2, a+b+a+b costs 2: the one piece. abc: a+bc costs 1.
    assert found == {
        "abab": [("abab", "NNG")],
        "": [],
        "xyab": [("xy", UNKNOWN), ("ab", "VV")],
        "abc": [("a", "NNG"), ("bc", UNKNOWN)],
    }
    nothing = spark.createDataFrame([], LEXICON)
    assert tokens_of(break_words(words, nothing).collect())["xyab"] == [("xyab", UNKNOWN)]
    assert break_words(words.limit(0), spark.createDataFrame(rows, LEXICON)).count() == 0


def test_long_word(spark):
    words = spark.createDataFrame([("ab" * 3000 + "x",)], "word string")
    lexicon = spark.createDataFrame([("ab", "NNG", None, 1), ("abab", "NNG", None, 1)], LEXICON)
    tokens = break_words(words, lexicon).first().tokens
    assert len(tokens) == 1501 and tokens[-1].form == "x"


def test_texts(spark):
    rows = [("1", "좋은영화, 최고영화!"), ("1", None), (None, ""), ("2", "영화는 xx"), ("3", "좋은영화, 최고영화!")]
    df = spark.createDataFrame(rows, "id string, text string")
    lexicon = spark.createDataFrame(
        [("좋은", "VA", "좋다", 1), ("영화", "NNG", None, 1), ("최고", "NNG", None, 1), ("는", "JX", None, 1)],
        LEXICON,
    )
    found = normalize_by_lexicon(df, lexicon, stopwords=["최고"]).collect()
    assert len(found) == len(rows)
    assert {(r.id, r.original_text, r.normalized_text) for r in found} == {
        ("1", "좋은영화, 최고영화!", "좋다 영화 영화"),
        ("1", None, ""),
        (None, "", ""),
        ("2", "영화는 xx", "영화"),
        ("3", "좋은영화, 최고영화!", "좋다 영화 영화"),
    }


class Shared:
    """As a broadcast variable."""

    def __init__(self, value):
        self.value = value


def test_a_part_asks_once_for_each_form_it_may_hold(spark):
    rows = [("ab", 1, "NNG", None), ("abab", 1, "NNG", None), ("영화는좋은영화", 1, "NNG", None)]
    known = spark.createDataFrame(rows, "form string, cost long, tag string, lemma string")
    steps = prefix_lengths(7)
    forms = _hashed(known, steps)
    sieve = _sieve(forms, LEAST_BITS)
    words = ["ab" * 3000, "abx", "영화는좋은영화", "영화"]
    group = pa.table({"part": pa.array([5] * 4, pa.int32()), "word": words})
    asked = _asking(Shared(sieve), LEAST_BITS, steps, "word")(group).to_pylist()
    # 6,008 places and up to seven lengths at each; before, each of these was a row.
    assert {r["part"] for r in asked} == {5} and len(asked) <= 8
    assert {r["hash"] for r in asked} >= {r.hash for r in forms.collect()}


def test_texts_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr("reviewlens.operators.lexicon.PART_BYTES", 64)
    rows = [(str(n % 7), f"abcab {n} abab" if n % 3 else None) for n in range(60)]
    lexicon = spark.createDataFrame([("ab", "NNG", "abby", 1), ("c", "VV", None, 2)], LEXICON)
    found = normalize_by_lexicon(spark.createDataFrame(rows, "id string, text string"), lexicon, stopwords=[])
    got = sorted((r.id, r.original_text or "", r.normalized_text) for r in found.collect())
    assert got == sorted((i, t or "", "abby c abby abby abby" if t else "") for i, t in rows)


def test_texts_are_worked_out_once(spark):
    """Dealing the texts, asking for their forms and the work share one pass over what makes the texts."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def make(text):
        made.add(1)
        return text + "ab"

    rows = [(str(n), f"abc{n}") for n in range(40)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("text", make("text"))
    lexicon = spark.createDataFrame([("ab", "NNG", None, 1)], LEXICON)
    assert normalize_by_lexicon(df, lexicon, stopwords=[]).collect()[0].normalized_text == "ab ab"
    assert made.value == len(rows)


@pytest.mark.parametrize("alphabet", ["ab", "ab영😀"])
def test_forms_are_found_at_all_their_places(alphabet):
    draw = random.Random(4)
    forms = sorted({"".join(draw.choices(alphabet, k=draw.randint(1, 20))) for _ in range(300)})
    words = ["", *("".join(draw.choices(alphabet, k=draw.randint(1, 60))) for _ in range(40)), forms[7] * 3]
    # Forms longer than 8 have beginnings in common.
    found = _Found(Spelled(pa.array(forms)), prefix_lengths(20))
    spelled = Spelled(pa.array(["x", *words])[1:])
    got = sorted((int(at), forms[form]) for at, form in zip(*found.edges(spelled)))
    joined = [(first, word) for first, word in zip(spelled.first.tolist(), words)]
    assert got == sorted((n + k, f) for n, word in joined for f in forms for k in range(len(word)) if word.startswith(f, k))
    assert not len(_Found(Spelled(pa.array([], pa.string())), []).edges(spelled)[0])
