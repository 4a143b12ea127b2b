import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import chat, packing, toxicity
from reviewlens.llm import text as T
from reviewlens.llm.queries import vocabulary

ODD = [
    "", None, "a\x0bb \x0c c", "don't  it's\xa0x <|endoftext|> y<|startoftext|>z", " ", "é é ́x Σας ΣΑΣ İI",
    "\x00 \x85 a b", "Æß×a÷b A1b2C33 x_y--z É..è don’t 12,5 <a> l'eau ÀÉÎ ÿŸ", "日本語 text　here",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_remembered_units_give_the_tokenizer_s_ids(monkeypatch, tokenizer):
    draw = random.Random(2)
    pieces = ["a", "É", "é", "'", "s", "1", "-", ".", " ", "\n", "\x0b", "<", "ß", "×", "ñ", "Ω", "́", "<|endoftext|>"]
    texts = ODD + ["".join(draw.choices(pieces, k=draw.randint(1, 30))) for _ in range(500)]
    for remembered in (2_500_000, 5):
        monkeypatch.setattr(packing, "REMEMBERED_UNITS", remembered)
        encode = packing.WordIds(vocabulary())
        for _ in range(2):
            ids, first = encode(pa.array(texts, pa.string()))
            for k, text in enumerate(texts):
                assert list(ids[first[k] : first[k + 1]]) == tokenizer.encode(text or "", add_special_tokens=False).ids, text


def best_sum(counts, space):
    reach = {0}
    for n, c in counts.items():
        for _ in range(c):
            reach |= {s + n for s in reach if s + n <= space}
    return max(reach)


def test_fill_is_the_closest_sum():
    draw = random.Random(3)
    for _ in range(200):
        counts = {draw.randint(1, 30): draw.randint(1, 4) for _ in range(draw.randint(1, 6))}
        space = draw.randint(0, 60)
        used = packing._best_fill(counts, space)
        assert all(used[n] <= counts[n] for n in used)
        assert sum(n * k for n, k in used.items()) == best_sum(counts, space)


def test_patterns_use_every_piece_once_and_waste_little():
    draw = random.Random(5)
    histogram = {n: draw.randint(0, 10**6) for n in range(1, 2049)}
    patterns = packing.fill_patterns(histogram)
    used: dict = {}
    for p in patterns:
        assert sum(n * k for n, k in p.lengths.items()) <= 2048
        for n, k in p.lengths.items():
            used[n] = used.get(n, 0) + k * p.times
    assert used == {n: c for n, c in histogram.items() if c}
    total = sum(n * c for n, c in histogram.items())
    assert total / (2048 * sum(p.times for p in patterns)) > 0.98
    assert len(patterns) < 2 * 2048
    assert packing.fill_patterns({}) == []


def check_packing(rows, docs, tokenizer, capacity):
    by_doc: dict = {}
    sequences: dict = {}
    for r in rows:
        assert len(r.ids) == r.length
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for d, text in docs.items():
        expected = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted(by_doc.pop(d), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == expected
        assert {r.doc_tokens for r in own} == {len(expected)}
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
    assert not by_doc
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("batch_bytes,capacity", [(1 << 21, 2048), (300, 32)])
def test_packing_is_an_exact_round_trip(docs_of, monkeypatch, tokenizer, batch_bytes, capacity):
    monkeypatch.setattr(T, "BATCH_BYTES", batch_bytes)
    draw = random.Random(6)
    docs = {k: t for k, t in enumerate(ODD)}
    docs |= {100 + d: " ".join(draw.choices(["word", "Tokens", "é", "x1"], k=draw.randint(0, 120))) for d in range(80)}
    docs |= {300 + d: "the same text" for d in range(50)}
    rows = packing.pack(docs_of(docs).repartition(6), vocabulary(), capacity).collect()
    check_packing(rows, docs, tokenizer, capacity)


def test_packing_edge_cases(docs_of):
    assert packing.pack(docs_of([]), vocabulary()).count() == 0
    rows = packing.pack(docs_of([(1, "a"), (1, "a"), (None, None)]), vocabulary()).collect()
    assert sorted((r.doc_id or -1, r.length) for r in rows) == [(-1, 1), (1, 2), (1, 2)]


def toxic_corpus(count=600):
    draw = random.Random(8)
    words = [f"w{draw.randrange(400)}" for _ in range(5000)]
    rows = []
    for d in range(count):
        own = draw.choices(words, k=draw.randint(5, 60))
        toxic = int(d % 4 == 0)
        if toxic:
            own[draw.randrange(len(own))] = draw.choice(["badword", f"vile{draw.randrange(10**6)}"])
        rows.append((d, " ".join(own), toxic))
    return rows


def test_toxicity_learns_words_and_stems(spark, docs_of):
    rows = toxic_corpus()
    docs = docs_of([(d, t) for d, t, _ in rows])
    labels = spark.createDataFrame(
        [(d, y, 0) for d, _, y in rows] + [(1, None, 0), (5, 7, 0), (10**6, 1, 0)], "doc_id long, toxic int, text int"
    )
    model = toxicity.fit(docs, labels, toxicity.Settings(steps=400))
    scored = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(d, y) for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    right = sum((scored[d].score >= 0.5) == y for d, y in held)
    assert len(held) > 80 and right / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in scored.values())
    found = docs.select("doc_id", toxicity.held_out().alias("h")).collect()
    assert {r.doc_id for r in found if r.h} == {d for d, _ in held}


def test_held_out_labels_change_nothing(spark, docs_of):
    rows = toxic_corpus(200)
    docs = docs_of([(d, t) for d, t, _ in rows])
    scores = []
    for flip in (False, True):
        own = [(d, 1 - y if flip and zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, _, y in rows]
        labels = spark.createDataFrame(own, "doc_id long, toxic int")
        model = toxicity.fit(docs, labels, toxicity.Settings(steps=30))
        scores.append({r.doc_id: r.score for r in toxicity.score(docs, model).collect()})
    assert scores[0] == scores[1]


def test_scores_do_not_depend_on_blocks_or_neighbours(monkeypatch):
    draw = np.random.default_rng(1)
    texts = [draw.integers(0, 50, (n, 2)).astype(np.int32) for n in (0, 1, 2, 3, 30, 90, 0)]
    labels = np.array([0, 1, 0, 1, 0, 1, 0])
    parts = toxicity.train(texts, labels, toxicity.Settings(steps=20, min_docs=1)).parts()
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = toxicity.probabilities(parts, np.concatenate(texts), first)
    alone = [toxicity.probabilities(parts, t, np.array([0, len(t)]))[0] for t in texts]
    np.testing.assert_allclose(whole, alone, rtol=1e-5)
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 7)
    np.testing.assert_allclose(toxicity.probabilities(parts, np.concatenate(texts), first), whole, rtol=1e-5)


def test_gradient_matches_differences():
    draw = np.random.default_rng(2)
    s = toxicity.Settings(dimension=3, widths=(1, 2), filters=2, drop_words=0.0)
    par = {"E": draw.normal(size=(toxicity.PAD + 1, 3)), "W": draw.normal(size=4), "c": np.zeros(1)}
    par["E"][toxicity.PAD] = 0
    for w in s.widths:
        par[f"K{w}"], par[f"b{w}"] = draw.normal(size=(w, 3, 2)), draw.normal(size=2)
    texts = [draw.integers(0, 9, (6, 2)).astype(np.int32) for _ in range(4)]
    labels, cost = np.array([0, 1, 1, 0]), np.ones(4)

    def loss():
        parts = {
            "tables": {w: [par["E"] @ k for k in par[f"K{w}"]] for w in s.widths},
            "biases": {w: par[f"b{w}"] for w in s.widths}, "weights": par["W"], "bias": par["c"][0],
        }
        p = toxicity.probabilities(parts, np.concatenate(texts), np.arange(0, 25, 6))
        return -np.mean(np.where(labels == 1, np.log(p), np.log(1 - p)))

    grad = toxicity._gradient(par, texts, labels, cost, s, np.random.default_rng(0))
    rows, change = grad.pop("E")
    grad["E"] = np.zeros_like(par["E"])
    grad["E"][rows] = change
    for name in par:
        for _ in range(4):
            at = tuple(draw.integers(0, n) for n in par[name].shape)
            if name == "E":
                at = (int(draw.choice(rows)), at[1])
            old, step = par[name][at], 1e-5
            par[name][at] = old + step
            up = loss()
            par[name][at] = old - step
            down = loss()
            par[name][at] = old
            assert abs((up - down) / (2 * step) - grad[name][at]) < 1e-3


def test_changes_of_shards_reach_the_driver_as_one_mean():
    change, shards = ([np.array(rows, np.float32).tobytes() for rows in own] for own in (
        [[3, 0, 1], [1, 0, 0]], [[1, 0, 1], [1, 0, 0]]
    ))
    mean = toxicity._averaged(pa.table({"change": change, "shards": shards}))
    assert mean.column_names == ["change"]
    assert np.frombuffer(mean["change"][0].as_py(), np.float32).tolist() == [2, 0, 1]


@pytest.mark.parametrize("shard_rows", [8000, 100])
def test_toxicity_learns_from_all_rows_and_whole_texts(spark, docs_of, shard_rows):
    """The label hangs on the last of 6,000 words in some texts; with few rows a shard there are several."""
    draw = random.Random(5)
    rows, labels = [], []
    for n in range(600):
        word = draw.choice(["vile", "kind"])
        rows.append((n, ("x " * 5999 if n % 30 == 0 else "a text ") + word))
        labels.append((n, int(word == "vile")))
    docs, known = docs_of(rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    settings = toxicity.Settings(steps=200, shard_rows=shard_rows)
    learned = toxicity._training_rows(docs, known)
    outside = docs.where(~toxicity.held_out()).count()
    assert learned.count() == outside and learned.where("size(words) = 12000").count() > 10
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, known, settings)).collect()}
    assert sum((scored[n] >= 0.5) == bool(toxic) for n, toxic in labels) > 0.98 * len(labels)


def test_toxicity_thresholds_of_counts():
    clean, toxic = np.zeros(toxicity.BINS, int), np.zeros(toxicity.BINS, int)
    clean[1000], clean[3000], toxic[7000] = 20, 5, 10
    assert toxicity._binned_threshold(clean, toxic) == pytest.approx(0.5, abs=1e-3)
    p, y = np.repeat([0.1, 0.3, 0.7], [20, 5, 10]), np.repeat([0, 0, 1], [20, 5, 10])
    assert toxicity.threshold(p, y) == pytest.approx(0.5, abs=1e-3)
    assert toxicity._binned_threshold(clean, 0 * toxic) == 0.5


def test_toxicity_edge_cases(spark, docs_of):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = docs_of([(1, None), (1, ""), (None, "a")])
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == 3 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(docs_of([]), model).count() == 0


TRICKY = ["", "\\", "\\<|end|>", "<\\|end|>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "a\nb\r", "<|tu<|turn|>rn|>", "é😀", "\\\\[INST]\\"]


def test_escape_is_reversible_and_hides_controls():
    draw = random.Random(4)
    pieces = [*chat.CONTROLS, "\\", "<", "|", "[", "INST]", "x", "\n"]
    for text in TRICKY + ["".join(draw.choices(pieces, k=draw.randint(0, 12))) for _ in range(3000)]:
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROLS)


def test_chats_of_every_layout(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "</s> a"}], "id": 4},
        2: {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]},
        3: {"instruction": "do", "input": "this", "output": "done", "conv_id": {"record": [1]}},
        4: {"instruction": "do", "output": "done"},
        5: {"prompt": "p", "completion": "c"},
        6: {"question": "p", "answer": "c", "meta": [{"x": [1, 2]}]},
        7: {"messages": []},
        8: {"unknown": "x"},
        9: {"dialog": [{"speaker": "Ann", "text": "hi"}, {"speaker": "bot", "text": "ho"}]},
        10: {"system": "be", "prompt": "p", "response": "r"},
        11: {"messages": None},
        12: [1, 2],
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(13, "{broken"), (14, None), (None, "{}")]
    table = spark.createDataFrame([(k, r, 1) for k, r in rows], "conv_id long, record string, layout int")
    found = {r.conv_id: r for r in chat.format_chats(table).collect()}
    assert len(found) == len(rows)
    turns = {k: chat.read_back(r.formatted) for k, r in found.items()}
    assert turns[1] == [("user", "q"), ("assistant", "</s> a")]
    assert turns[2] == [("user", "q"), ("assistant", "")]
    assert turns[3] == [("user", "do\n\nthis"), ("assistant", "done")]
    assert turns[4] == [("user", "do"), ("assistant", "done")]
    assert turns[5] == turns[6] == [("user", "p"), ("assistant", "c")]
    assert turns[9] == [("Ann", "hi"), ("assistant", "ho")]
    assert turns[10] == [("system", "be"), ("user", "p"), ("assistant", "r")]
    assert [found[k].layout for k in (7, 8, 11, 12, 13, 14)] == ["messages", None, "messages", None, None, None]
    assert all(turns[k] == [] for k in (7, 8, 11, 12, 13, 14, None))
    loss = {k: [r.formatted[s.start : s.stop] for s in r.loss_spans] for k, r in found.items()}
    assert [chat.unescape(x) for x in loss[1]] == ["</s> a"] and loss[9] == ["ho"]


def test_turn_rows_round_trip(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(TRICKY)]
    rows += [(2, 0, None, None), (2, None, "assistant", "first"), (3, 1, "b", "x"), (3, 1, "a", "y"), (None, 0, "user", "z")]
    table = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, content int")
    chats = chat.format_chats(chat.records_of_turns(table)).collect()
    turns = {r.conv_id: chat.read_back(r.formatted) for r in chats}
    assert turns[1] == [(role, text) for _, _, role, text in rows[: len(TRICKY)]]
    assert turns[2] == [("assistant", "first"), ("", "")]
    assert turns[3] == [("a", "y"), ("b", "x")]
    assert turns[None] == [("user", "z")]
    one = chat.digests(chat.format_chats(chat.records_of_turns(table.where("conv_id = 1")))).first()
    assert one.n_turns == len(TRICKY) and one.loss_chars == sum(map(len, TRICKY[1::2]))
    assert chat.records_of_turns(table.where("conv_id = 99")).count() == 0
