"""Hard negatives by the threshold algorithm over lists that are sorted dimension by dimension.

Rows are dealt into blocks and anchors into bundles; a task holds one of each. In a block the rows
are listed once per dimension, in the order of that component. An anchor reads all lists from the
end its own component's sign asks for (sorted access), scores each row it meets for the first time
in whole numbers (random access), and knows that no row unseen scores more than the sum, over
dimensions, of the anchor's component times the one reached (the threshold). It stops when the
threshold lies strictly below the score of the last row wanted, in every window of scores asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlens.llm.text import bounded_batches
from reviewlens.llm.whitening import whole_vector
from reviewlens.storage import scratch_path

# Rows of a block and anchors of a bundle.
BLOCK_ROWS = 8192
BUNDLE_ROWS = 512
# Places of every list that are read in the first step; each step doubles them.
FIRST_STEP = 16

_FOUND = "anchor string, floor long, score long, vec_id long, row string"


class Lists:
    """Rows of a block with their places in the order of each dimension, smallest first."""

    def __init__(self, rows: np.ndarray, tie: np.ndarray):
        self.rows, self.tie = rows, tie
        self.order = np.argsort(rows, axis=0, kind="stable")

    def __len__(self) -> int:
        return len(self.rows)


@dataclass
class Wanted:
    """The best rows of one window of scores, as far as they are known."""

    low: int
    high: int
    scores: np.ndarray
    rows: np.ndarray

    def take(self, scores: np.ndarray, rows: np.ndarray, lists: Lists, k: int) -> None:
        inside = (scores >= self.low) & (scores <= self.high)
        if inside.any():
            scores = np.concatenate([self.scores, scores[inside]])
            rows = np.concatenate([self.rows, rows[inside]])
            best = np.lexsort((lists.tie[rows], -scores))[:k]
            self.scores, self.rows = scores[best], rows[best]

    def closed(self, threshold: int, k: int) -> bool:
        """Whether no row that scores ``threshold`` or less can still get in."""
        return threshold < self.low or (len(self.scores) >= k and threshold < self.scores[-1])


def search(
    lists: Lists, anchor: np.ndarray, windows: list[tuple[int, int]], k: int, skip: np.ndarray
) -> list[Wanted]:
    """The first ``k`` rows of each window, by falling score, then ``tie``; not those of ``skip``."""
    none = np.zeros(0, np.int64)
    wanted = [Wanted(low, high, none.astype(lists.rows.dtype), none) for low, high in windows]
    seen = skip.copy()
    active = np.flatnonzero(anchor != 0)
    if not len(active) or not len(lists):
        # All rows score nought: there is nothing to sort by.
        rest = np.flatnonzero(~seen)
        for own in wanted:
            own.take(lists.rows[rest] @ anchor, rest, lists, k)
        return wanted
    falling = anchor[active] > 0
    weights = anchor[active]
    depth, step = 0, FIRST_STEP
    while depth < len(lists):
        to = min(depth + step, len(lists))
        up = lists.order[depth:to, active[~falling]]
        down = lists.order[len(lists) - to : len(lists) - depth, active[falling]]
        met = np.zeros(len(lists), bool)
        met[up.ravel()] = met[down.ravel()] = True
        met &= ~seen
        seen |= met
        new = np.flatnonzero(met)
        scores = lists.rows[new] @ anchor
        last = np.where(falling, lists.order[len(lists) - to, active], lists.order[to - 1, active])
        threshold = (lists.rows[last, active] * weights).sum()
        for own in wanted:
            own.take(scores, new, lists, k)
        if all(own.closed(threshold, k) for own in wanted) or seen.all():
            break
        depth, step = to, step * 2
    return wanted


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """A list column as rows, in 64 bits if all scores fit there and else without a bound."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)
    top = max((abs(int(v)) for v in (rows.min(initial=0), rows.max(initial=0))), default=0)
    return rows if top * top * max(rows.shape[1], 1) < 1 << 62 else rows.astype(object)


def _ranked(rows: pa.Table) -> np.ndarray:
    """Each row's place in the order of vec_id, then its digest."""
    places = rows.select(["vec_id", "row"]).to_pandas()
    order = places.sort_values(["vec_id", "row"]).index.to_numpy()
    tie = np.empty(len(order), np.int64)
    tie[order] = np.arange(len(order))
    return tie


def _matcher(k: int, same: bool):
    """For a block and a bundle: what each anchor finds in each of its windows."""

    def find(anchors: pa.Table, hosts: pa.Table) -> pa.Table:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        names = [f.split()[0] for f in _FOUND.split(", ")]
        out: list[list] = [[] for _ in names]
        if anchors.num_rows and hosts.num_rows:
            own, rows = _numbers(anchors["x"]), _numbers(hosts["x"])
            if own.dtype != rows.dtype:
                own, rows = own.astype(object), rows.astype(object)
            label = hosts["label"].to_numpy()
            lists = Lists(rows, _ranked(hosts))
            ids, digests = hosts["vec_id"].to_numpy(), np.array(hosts["row"].to_pylist(), object)
            bounds = anchors["windows"].to_pylist()
            about = zip(anchors["row"].to_pylist(), anchors["label"].to_pylist(), own, bounds)
            for name, group, vector, windows in about:
                skip = digests == name if same else label == group
                asked = [(w["low"], w["high"]) for w in windows]
                for w, got in zip(windows, search(lists, vector, asked, k, skip)):
                    for score, row in zip(got.scores, got.rows):
                        values = (name, w["floor"], int(score), int(ids[row]), digests[row])
                        for column, value in zip(out, values):
                            column.append(value)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return find


def _dealt(rows: DataFrame, size: int, part: str) -> DataFrame:
    """Rows with the number of their part within their kind, and how many parts the kind has."""
    counts = rows.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(f"{part}s"))
    numbered = rows.join(counts, "kind")
    return numbered.withColumn(part, F.pmod(F.xxhash64("row"), F.col(f"{part}s")).cast("int"))


def _met(anchors: DataFrame, hosts: DataFrame, kind: Column, k: int, same: bool) -> DataFrame:
    """The best rows each anchor finds in each block of its kind, unmerged.

    Rows of one kind, however many, are spread over its blocks by their digest.
    """
    bundles = _dealt(anchors.withColumn("kind", kind), BUNDLE_ROWS, "bundle")
    blocks = _dealt(hosts.withColumn("kind", kind), BLOCK_ROWS, "block")
    parts = bundles.select("kind", "bundles").distinct().join(
        blocks.select("kind", "blocks").distinct(), "kind"
    )

    def copied(rows: DataFrame, count: str, name: str) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(0), F.col(count) - 1))
        return rows.join(parts.select("kind", count), "kind").withColumn(name, numbers)

    key = ["kind", "bundle", "block"]
    left = copied(bundles, "blocks", "block").select(*key, "row", "label", "x", "windows")
    right = copied(blocks, "bundles", "bundle").select(*key, "vec_id", "row", "label", "x")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_matcher(k, same), _FOUND)


def participants(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x, width and a digest for each row that takes part, equal rows once."""
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        whole_vector(F.col("embedding"), scale).alias("x"),
    ).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull())
    digest = F.md5(F.to_json(F.struct("vec_id", "label", "x")))
    return rows.distinct().withColumns({"row": digest, "width": F.size("x")})


def mine_negatives(
    embeddings: DataFrame,
    is_anchor: Column | None = None,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """For every anchor and positive, the hardest rows of other labels within a window of scores.

    ``embeddings``: vec_id, label, embedding; other columns are ignored. Components count as
    floor(scale * component); a row's score is the whole inner product with the anchor; higher
    scores come first, equal ones by smaller vec_id. ``is_anchor`` tests vec_id (all rows without
    it). An anchor's positives are its first ``positives`` other rows of its label; negatives are the
    first rows of other labels that score from ``low`` to ``high`` percent of the positive's score.
    Result: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; an
    anchor or positive without any has no rows.

    Rows with a null id, label or vector, or a component that is null, infinite or undefined, take
    no part. Rows equal in all three columns are one row; different rows of one id are rows of their
    own, ordered by digest where their scores are equal, and as anchors mine separately. Vectors of
    different lengths never meet; those of length 0 score nought. Scores must fit in 64 bits. No
    rows, no result.

    Exact: all anchors meet all rows, in blocks of bounded size; the threshold decides how much of
    a block they read. The number of meetings is anchors times rows / (512 * 8192).
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    path = scratch_path(spark, "negatives")
    participants(embeddings, scale).write.parquet(f"{path}/rows")
    # Read twice: anchors and rows are two tables to Spark, whose columns cannot be confused.
    rows, anchors = (spark.read.parquet(f"{path}/rows") for _ in range(2))
    anchors = anchors if is_anchor is None else anchors.where(is_anchor)
    edge = (1 << 63) - 1
    everything = F.array(
        F.struct(F.lit(0).cast("long").alias("floor"), F.lit(-edge).alias("low"), F.lit(edge).alias("high"))
    )
    kind = F.concat_ws(":", "width", "label")
    own = _met(anchors.withColumn("windows", everything), rows, kind, positives, same=True)
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row")
    best = own.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    best.select("anchor", "vec_id", "score", "place").write.parquet(f"{path}/positives")
    best = spark.read.parquet(f"{path}/positives")

    # low * p <= 100 * s <= high * p, for whole s.
    score = F.col("score").cast("decimal(38,0)")
    window = F.struct(
        F.col("score").alias("floor"),
        F.ceil(score * low / 100).cast("long").alias("low"),
        F.floor(score * high / 100).cast("long").alias("high"),
    )
    asked = best.groupBy(F.col("anchor").alias("row")).agg(F.collect_set(window).alias("windows"))
    asked = asked.withColumn("windows", F.filter("windows", lambda w: w["low"] <= w["high"]))
    seekers = anchors.join(asked.where(F.size("windows") > 0), "row")
    other = _met(seekers, rows, F.col("width").cast("string"), negatives, same=False)
    nth = Window.partitionBy("anchor", "floor").orderBy(F.desc("score"), "vec_id", "row")
    ranked = other.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= negatives)
    found = ranked.select(
        "anchor", "floor", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    chosen = best.select(
        "anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = chosen.join(
        found.withColumnRenamed("floor", "positive_score"), ["anchor", "positive_score"]
    )
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return pairs.join(ids, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
