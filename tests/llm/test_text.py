import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import text as T
from tests_llm_brute import ALNUM, SPACED, lower

PIECES = [" ", "\n", "\t", "\x0b", "\x00", "\x7f", "a", "b", "A", "é", " ", ".", "9", "_", "😀"]


def texts(seed, count=300):
    draw = random.Random(seed)
    return ["".join(draw.choices(PIECES, k=draw.randint(0, 50))) for _ in range(count)] + [None, ""]


@pytest.mark.parametrize("step", [1 << 21, 40])
@pytest.mark.parametrize(
    "table,pattern,change",
    [
        (T.spaced_table(False), SPACED, str),
        (T.spaced_table(True), SPACED, lower),
        (T.alphanumeric_table(), ALNUM, lower),
    ],
)
def test_words_match_the_pattern(monkeypatch, step, table, pattern, change):
    monkeypatch.setattr(T, "BATCH_BYTES", step)
    own = texts(3)
    words = T.words_of(pa.array(own, pa.string()), table)
    names = {}
    for k, text in enumerate(own):
        expected = pattern.findall(change(text or ""))
        found = words.hashes[words.first[k] : words.first[k + 1]]
        assert len(expected) == len(found)
        for word, number in zip(expected, found):
            assert names.setdefault(word, number) == number
    assert len(set(names.values())) == len(names)


def test_slices_keep_all_rows_and_null_texts(monkeypatch):
    monkeypatch.setattr(T, "BATCH_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"k": [1, 2, 3, 4], "text": ["x" * 50, None, "", "y" * 4]})
    parts = list(T.slices([batch], "text"))
    assert [r for p in parts for r in p.column(0).to_pylist()] == [1, 2, 3, 4]
    assert len(parts) > 1


def test_span_hashes_do_not_depend_on_the_place():
    words = np.array([5, 6, 7, 5, 6, 7, 8], np.uint64)
    a = T.span_hashes(words, np.array([0, 3, 0]), np.array([3, 6, 2]))
    assert a[0] == a[1] != a[2]
