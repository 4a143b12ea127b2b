"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.binary import read_tokens, write_tokens
from reviewlens.llm.chat import digests, format_chats, records_of_turns
from reviewlens.llm.decontaminate import find_passages, hit_words
from reviewlens.llm.licenses import scan_licenses
from reviewlens.llm.lines import drop_frequent_lines
from reviewlens.llm.minhash import near_duplicates
from reviewlens.llm.negatives import mine_negatives
from reviewlens.llm.packing import pack
from reviewlens.llm.recompression import remove_repeats
from reviewlens.llm.secrets import find_secrets, spans_text
from reviewlens.llm.toxicity import fit, held_out, score
from reviewlens.llm.vectors import link_vectors
from reviewlens.llm.whitening import whiten
from reviewlens.plans.bridges import table
from reviewlens.storage import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[function.__name__] = function
    return function


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = drop_frequent_lines(table(spark, folder, "documents"), min_docs=10, min_chars=1)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), vocabulary()).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    return score(docs, model).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op3_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return link_vectors(table(spark, folder, "embeddings"), cosine=0.98)


@query
def op2_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), size=4, share=0.8)


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = remove_repeats(table(spark, folder, "documents"), size=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda p: p["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(spans_text("base"), 256).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


@query
def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)],
        "conv_id long, turn long, role string, text string",
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(records_of_turns(turns.unionByName(extra))))


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licenses(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op11_binary_output(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "segments")
    write_tokens(table(spark, folder, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path)


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whiten(table(spark, folder, "embeddings"), components=4, scale=256)
    # Past 64 bits the long is null; the decimal holds the number all the same.
    return rows.withColumnRenamed("deviation", "deviation_exact").select(
        "vec_id",
        "component",
        "n",
        F.col("deviation_exact").try_cast("long").alias("deviation"),
        "whitened",
        "explained",
        "identity_error",
        "deviation_exact",
    )


@query
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return mine_negatives(
        rows, is_anchor=F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95, scale=256
    )
