"""The corpus pipeline: documents go through the stages in order, each over all that came before.

Every stage is (name, function of spark, docs and the folder of the tables). All but the last return
the columns of ``documents``; each result is written as Parquet and read again by the next stage.
Rows that share a doc_id, nulls included, share the fate of that id: a stage that takes out documents
takes out all of them. Null texts count as empty; no documents, no rows; columns of ``docs`` may have
any names beside those of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm.decontaminate import find_passages
from reviewlens.llm.lines import drop_frequent_lines
from reviewlens.llm.minhash import near_duplicates
from reviewlens.llm.packing import pack
from reviewlens.llm.queries import vocabulary
from reviewlens.llm.toxicity import fit, score
from reviewlens.plans.bridges import table
from reviewlens.storage import scratch_path

# No SQL: the classifier and the tokeniser cannot be written in it.
ORACLE_SQL = None


def _quoted(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among those of ``ids``."""
    name = "out_id"
    while name in {column.lower() for column in docs.columns}:
        name += "_"
    out = ids.select(F.col("doc_id").alias(name))
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that the classifier calls toxic."""
    model = fit(docs, table(spark, folder, "labels"))
    return _without(docs, score(docs, model).where("score >= 0.5"))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the lines that stand in ten documents or more; n_chars follows the text."""
    # The other columns travel as one, under names that cannot clash with the operator's.
    place = {name: f"c{k}" for k, name in enumerate(docs.columns) if name not in ("doc_id", "text")}
    others = F.struct(F.lit(0).alias("none"), *[_quoted(n).alias(c) for n, c in place.items()])
    packed = docs.select("doc_id", "text", others.alias("others"))
    rows = drop_frequent_lines(packed, min_docs=10, min_chars=1, carry=("others",))
    own = {name: F.col("others").getField(c) for name, c in place.items()}
    if "n_chars" in own:
        length = F.when(F.col("n_dropped") == 0, own["n_chars"]).otherwise(F.char_length("text"))
        own["n_chars"] = length.cast("long")
    return rows.select([own.get(name, F.col("text" if name == "text" else "doc_id")).alias(name) for name in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles: the one with the smallest id."""
    groups = near_duplicates(docs, size=5, share=0.8)
    return _without(docs, groups.where("doc_id <> component_id"))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item."""
    found = find_passages(docs, table(spark, folder, "benchmark"))
    return _without(docs, found.where(F.size("spans") > 0))


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of the remaining documents in their sequences."""
    return pack(docs, vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage on the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{number}-{name}")
        docs = spark.read.parquet(f"{path}/{number}-{name}")
    return docs
