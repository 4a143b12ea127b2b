"""Each query and the pipeline over the smallest tables, against SQL or its brute-force version."""

import pytest

import corpus_pipeline
import tests_llm_brute as brute
from compare import connect, difference
from reviewlens.llm.oracles import ORACLES
from reviewlens.llm.queries import QUERIES, vocabulary
from test_models import check_packing

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_all_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def texts_of(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_secret_query(spark):
    docs = texts_of(spark)
    rows = QUERIES["op1_secret_scan"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        base = brute.base_secrets(docs[r.doc_id])
        kinds = [k for k, _, _ in base]
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in ("assign", "access", "hex")]
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == brute.sha(",".join(said))
        assert set(said) <= set(r.spans.split(","))


def test_license_query(spark):
    docs = texts_of(spark)
    for r in QUERIES["op8_license_scan"](spark, FOLDER).collect():
        n, places, labels = brute.phrase_places(docs.pop(r.doc_id))
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(labels))
        assert set(labels) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert not docs


def test_toxicity_query(spark):
    rows = QUERIES["op7_toxicity"](spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == set(texts_of(spark))
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_pipeline_stage_by_stage(spark):
    """Every stage on what its predecessor kept; the texts of the last are read back from the ids."""
    from tokenizers import Tokenizer

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    benchmark = {r.item_id: r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        after = {r.doc_id: r.text for r in rows}
        assert docs.columns == columns and len(after) == len(rows)
        if name == "toxicity":
            scored = QUERIES["op7_toxicity"](spark, FOLDER).collect()
            assert set(after) == {r.doc_id for r in scored if not r.predicted}
        elif name == "line_dedup":
            assert after == {d: v[0] for d, v in brute.drop_lines(before, 10).items()}
        elif name == "near_dedup":
            assert set(after) == {d for d, v in brute.near_duplicates(before, 5, 80).items() if v[2]}
        else:
            assert set(after) == {d for d, v in brute.passages(before, benchmark, 10).items() if not v[1]}
        docs = spark.createDataFrame(rows, docs.schema)
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    check_packing(last, before, Tokenizer.from_file(vocabulary()), 2048)
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in whole) == sorted((r.doc_id, r.start, r.ids_crc32) for r in last)


def test_stages_with_nulls_repeats_and_empties(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    long = " ".join(f"w{k}" for k in range(30))
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("item_id = 0").first().text
    rows = [
        (1, long, "en", None, 5), (1, long, "en", None, 5), (2, long + " x", None, "s", None),
        (None, None, None, None, None), (3, "", "en", "s", 0), (4, bench, "en", "s", 9),
    ]
    rows += [(10 + k, f"own {k}\nShared line", "en", "s", 1) for k in range(10)]
    docs = spark.createDataFrame(rows, schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.schema.simpleString() == schema.simpleString()
        kept[name] = sorted((r.doc_id or -1, r.text, r.n_chars) for r in out.collect())
    assert kept["line_dedup"][0] == (-1, "", None) and (10, "own 0", 5) in kept["line_dedup"]
    assert kept["line_dedup"].count((1, long, 5)) == 2 and (2, long + " x", None) in kept["line_dedup"]
    assert [r[0] for r in kept["near_dedup"]] == [-1, 1, 1, 3, 4, *range(10, 20)]
    assert [r[0] for r in kept["decontamination"]] == [-1, 1, 1, 2, 3, *range(10, 20)]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert sorted({r.doc_id or -1 for r in pieces}) == [-1, 1, 2, 3, 4, *range(10, 20)]
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, FOLDER).count() == 0


def test_stages_with_clashing_columns(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "out_id", "n_dropped", "n_lines", "a.b", "c`d", "id", "same"]
    rows = [(k, f"own words number {k} here\nShared line", "en", "s", 1, *range(7)) for k in range(12)]
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        kept = out.collect()
        assert out.columns == names and len(kept) == 12, name
        assert all(tuple(r)[5:] == tuple(range(7)) for r in kept)
        if name == "line_dedup":
            assert all(r.text == f"own words number {r.doc_id} here" and r.n_chars == len(r.text) for r in kept)
