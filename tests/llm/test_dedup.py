import random

import numpy as np
import pytest

import tests_llm_brute as brute
from reviewlens.llm import minhash, recompression, vectors
from reviewlens.llm import text as T
from reviewlens.llm.components import components
from reviewlens.llm.lines import count_lines, drop_frequent_lines, line_key
from reviewlens.llm.minhash import near_duplicates
from reviewlens.llm.recompression import remove_repeats
from reviewlens.llm.vectors import link_vectors


def corpus(seed, count=120, vocabulary=60):
    """Texts with copies, near copies, shared passages, runs, nulls and empties."""
    draw = random.Random(seed)
    words = [f"W{k}" if k % 7 else f"é{k}" for k in range(vocabulary)]
    passage = draw.choices(words, k=30)
    out = {}
    for d in range(count):
        kind = draw.random()
        own = draw.choices(words, k=draw.randint(0, 80))
        if kind < 0.25 and out:
            own = (out[draw.choice(list(out))] or "").split()
            for _ in range(draw.randint(0, 4)):
                if own:
                    own[draw.randrange(len(own))] = draw.choice(words)
        elif kind < 0.4:
            at = draw.randint(0, len(own))
            own[at:at] = passage[draw.randint(0, 8) :]
        elif kind < 0.5:
            own = ["a"] * draw.randint(0, 40) + own[:10] + ["b", "c"] * draw.randint(0, 20)
        out[d * 3] = draw.choice([" ", "\n", "  "]).join(own)
    out[1], out[2] = None, ""
    return out


def test_components_of_a_chain_a_star_and_a_loop(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 200)]
    links += [(None, 5), (5, None)]
    draw = random.Random(1)
    draw.shuffle(links)
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = brute.components(
        {n for e in links if None not in e for n in e}, [e for e in links if None not in e]
    )
    assert {r.node: r.component for r in found} == expected


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_take_few_tasks(spark):
    """The driver keeps something of every task. Overlapping stars in 40 partitions took 1,503 of them."""
    draw = random.Random(3)
    links = [(c, draw.randrange(1, 400)) for c in draw.sample(range(1, 400), 12) for _ in range(60)]
    plain = {
        name: spark.conf.get(name)
        for name in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    }
    for name, value in zip(plain, ("40", "false")):
        spark.conf.set(name, value)
    spark.sparkContext.setJobGroup("few tasks", "components")
    try:
        found = components(spark.createDataFrame(links, "a long, b long")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in plain.items():
            spark.conf.set(name, value)
    assert {r.node: r.component for r in found} == brute.components({n for e in links for n in e}, links)
    tracker = spark.sparkContext.statusTracker()
    jobs = [tracker.getJobInfo(job) for job in tracker.getJobIdsForGroup("few tasks")]
    stages = [tracker.getStageInfo(stage) for job in jobs for stage in job.stageIds]
    assert sum(stage.numCompletedTasks for stage in stages if stage) <= 1300


def test_components_go_on_from_those_of_some_links(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)]
    first, more = (spark.createDataFrame(rows, "a long, b long") for rows in (links[:150], links[150:]))
    found = components(first.unionByName(more), known=components(first)).collect()
    assert {r.node: r.component for r in found} == brute.components({n for e in links for n in e}, links)


@pytest.mark.parametrize("batch_bytes", [1 << 21, 400])
def test_near_duplicates_equal_brute_force(docs_of, monkeypatch, batch_bytes):
    docs = corpus(5, 150)
    monkeypatch.setattr(T, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(minhash, "MEMBERS", 3)
    rows = near_duplicates(docs_of(docs).repartition(5), size=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute.near_duplicates(docs, 4, 80)


@pytest.mark.parametrize("members,columns", [(256, 8192), (8, 16)])
def test_near_duplicates_of_a_family_of_uneven_copies(docs_of, monkeypatch, members, columns):
    """Some copies resemble many others, some few and some none; blocks are small in the second case."""
    monkeypatch.setattr(minhash, "MEMBERS", members)
    monkeypatch.setattr(minhash, "COLUMNS", columns)
    draw = random.Random(11)
    own = [f"w{draw.randrange(10**6)}" for _ in range(150)]
    docs = {}
    for d in range(90):
        copy = list(own)
        for _ in range(draw.randint(0, 14)):
            copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
        docs[(d * 37) % 1000] = " ".join(copy)
    expected = brute.near_duplicates(docs, 4, 80)
    assert 3 < len({v[1] for v in expected.values()}) < 80
    rows = near_duplicates(docs_of(docs).repartition(4), size=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == expected


def test_near_duplicates_of_a_chain_of_edits(docs_of):
    """Each text resembles the next, the ends do not: one component all the same."""
    draw = random.Random(2)
    own = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    docs = {}
    for d in range(30):
        docs[d] = " ".join(own)
        own[d * 4] = f"x{d}"
    assert brute.near_duplicates(docs, 5, 80)[29] == (116, 0, False)
    rows = near_duplicates(docs_of(docs), size=5).collect()
    assert {(r.component_id, r.kept) for r in rows if r.doc_id} == {(0, False)}


def test_near_duplicates_edge_cases(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    rows = near_duplicates(docs_of([(1, "a b"), (1, "a b"), (2, "A B"), (None, "a b"), (3, None), (4, " ")])).collect()
    found = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in rows)
    assert found == [
        (-1, 1, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True),
    ]


def test_signature_values_estimate_resemblance():
    draw = np.random.default_rng(3)
    both = draw.integers(0, 2**63, 800, dtype=np.uint64)
    sets = [np.unique(np.concatenate([both, draw.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(2)]
    values = np.concatenate(sets)
    keys = minhash.min_max_signatures(values, np.array([0, len(sets[0])]), 400, seed=1)
    expected = (800 / 1000) ** 4
    assert abs((keys[0] == keys[1]).mean() - expected) < 0.08


@pytest.mark.parametrize("batch_bytes", [1 << 21, 300])
@pytest.mark.parametrize("size", [5, 13])
def test_remove_repeats_equals_brute_force(docs_of, monkeypatch, size, batch_bytes):
    monkeypatch.setattr(T, "BATCH_BYTES", batch_bytes)
    docs = corpus(size, 120, vocabulary=12)
    rows = remove_repeats(docs_of(docs).repartition(7), size=size).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in rows} == brute.remove_repeats(docs, size)


def test_remove_repeats_edge_cases(docs_of):
    assert remove_repeats(docs_of([])).count() == 0
    long = " ".join(f"w{k}" for k in range(40))
    rows = remove_repeats(docs_of([(5, long), (5, long), (None, long), (9, "x " + long), (7, "a")])).collect()
    found = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in rows)
    assert found == [(-1, 40, 40), (5, 40, 0), (5, 40, 0), (7, 1, 0), (9, 41, 40)]


def test_equal_passages_have_equal_symbols_inside():
    """What a symbol needs decides it: it stands at the same place in any other surroundings."""
    draw = np.random.default_rng(4)
    core = draw.integers(0, 4, 60).astype(np.uint64)
    views = []
    for _ in range(2):
        around = [draw.integers(0, 4, 25).astype(np.uint64) for _ in range(2)]
        words = T.mix(np.concatenate([around[0], core, around[1]]) + np.uint64(1))
        first = np.array([0, len(words)])
        seen = set()
        for number, level in enumerate(recompression.levels(words, first, 9)):
            inside = (level.need_start >= 25) & (level.need_stop <= 85)
            seen |= {(number, int(n), int(a)) for n, a in zip(level.name[inside], level.start[inside])}
        views.append(seen)
    assert views[0] == views[1] and len(views[0]) > 60


def test_lines_equal_brute_force(docs_of):
    docs = {d: t for d, t in corpus(8, 100, vocabulary=5).items()}
    docs |= {1000 + d: f"Own {d}\n  Shared\tLine \n\nshared\tline" for d in range(12)}
    rows = drop_frequent_lines(docs_of(docs), min_docs=10).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in rows} == brute.drop_lines(docs, 10)


def test_line_runs_are_compacted_and_count_every_batch(spark, docs_of):
    docs = docs_of({d: f"a\nb{d % 4}" for d in range(40)})
    runs = count_lines(docs, min_docs=1000, n_batches=9, fanout=2)
    assert sum(map(len, runs.levels)) < 9
    assert sorted(r.n_docs for r in runs.counts().collect()) == [10, 10, 10, 10, 40]


def test_lines_edge_cases(docs_of):
    assert drop_frequent_lines(docs_of([])).count() == 0
    rows = drop_frequent_lines(docs_of([(1, "x\ny"), (1, "x\ny"), (None, "X "), (2, None), (3, "")]), min_docs=3)
    found = sorted((r.doc_id or -1, r.text, r.n_lines, r.n_dropped) for r in rows.collect())
    assert found == [(-1, "", 1, 1), (1, "y", 2, 1), (1, "y", 2, 1), (2, "", 1, 0), (3, "", 1, 0)]


def test_line_key_strips_only_ascii_space(spark):
    rows = spark.createDataFrame([("  Aé\t\x0b",)], "t string").select(line_key("t").alias("k"))
    assert rows.first().k == "  aé"


def vector_rows(seed):
    draw = np.random.default_rng(seed)
    rows, centre = [], draw.normal(size=8)
    for k in range(140):
        own = centre + draw.normal(size=8) * 0.08 if k % 2 else draw.normal(size=8)
        rows.append((k, [float(x) for x in own], int(k % 3 == 0)))
    rows += [(200, rows[1][1], rows[1][2]), (201, rows[1][1], rows[1][2]), (202, [0.0] * 8, 1)]
    rows += [(203, None, 1), (204, [float("nan")] * 8, 1), (205, [None] + [1.0] * 7, 1)]
    rows += [(206, [1e300] * 8, 0), (207, [1e-300] * 8, 0), (208, rows[1][1], None), (209, [1.0], 0), (210, [], 0)]
    return rows


def brute_links(rows, cosine):
    def unit(v):
        if not v or None in v or not np.isfinite(v).all() or not np.any(v):
            return None
        v = np.array(v) / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = {i: unit(v) for i, v, label in rows}
    links = [
        (a, b)
        for k, (a, _, la) in enumerate(rows)
        for b, _, lb in rows[k + 1 :]
        if la is not None and la == lb and units[a] is not None and units[b] is not None
        and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine
    ]
    part = brute.components([r[0] for r in rows], links)
    return {i: (sum(i in e for e in links), part[i], part[i] == i) for i, _, _ in rows}


@pytest.mark.parametrize("block", [512, 7])
def test_vectors_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = vector_rows(6)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    table = table.selectExpr("*", "1 AS id", "2 AS signs", "3 AS links")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(table, 0.97).collect()}
    assert found == brute_links(rows, 0.97)


def test_vectors_edge_cases(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert link_vectors(empty).count() == 0
    rows = spark.createDataFrame([(1, [1.0], 0), (1, [1.0], 0), (None, [1.0], 0)], "vec_id long, embedding array<float>, label int")
    found = sorted((r.vec_id or -1, r.n_links, r.kept) for r in link_vectors(rows).collect())
    assert found == [(-1, 0, False), (1, 1, True), (1, 1, True)]


def test_planned_tables_keep_their_promise():
    import math

    for rows in (0, 10, 10**6, 10**12):
        bits, tables = vectors.plan_tables(rows, 0.98)
        agree = (1 - math.acos(0.98) / math.pi) ** bits
        assert (1 - agree) ** tables <= 1e-6


def test_an_id_with_several_texts_joins_what_resembles_each(docs_of):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = near_duplicates(docs_of([(3, one), (7, one), (7, two), (9, two + " end"), (11, "x y z")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(3, 3), (7, 3), (7, 3), (9, 3), (11, 11)]


def test_an_id_with_several_vectors_is_one_node(spark):
    near = [0.0, 1.0, 0.01]
    rows = [(3, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (9, near), (11, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found = sorted((r.vec_id, r.component_id, r.n_links, r.kept) for r in link_vectors(table).collect())
    assert found == [(3, 3, 1, True), (7, 3, 1, False), (7, 3, 1, False), (9, 3, 1, False), (11, 11, 0, True)]
