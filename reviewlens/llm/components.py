"""Connected components of a link table that lives in Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.storage import stored


def components(
    links: DataFrame, left: str = "a", right: str = "b", known: DataFrame | None = None
) -> DataFrame:
    """(node, component) for every node of a link; the component is the smallest node reachable.

    ``known``: the result for some of the links, from which the work goes on.

    Every node has a parent in its component, at first its smallest neighbour. In a round, a node looks
    at the grandparents of its neighbours: the smallest becomes the parent of the node and of
    the node's parent, if it is smaller than what they have, and the node's own grandparent may too. When a
    round changes no parent, all nodes of a component hang under the smallest. Rounds are about the
    logarithm of the longest chain, and each is stored once: the driver keeps something of every task
    and exchange, so few of them matter. Only minima are ever gathered per node, never a list of
    neighbours, so a node with a third of all links costs one row per task. A null end makes no link;
    loops make a component of one node; no links, no rows.
    """
    pairs = links.select(F.col(left).alias("a"), F.col(right).alias("b")).dropna()
    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    once = stored(ordered.distinct(), "links")
    edges = once.unionByName(once.select(F.col("b").alias("a"), F.col("a").alias("b")))
    parents = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up"))
    if known is not None:
        parents = parents.join(_merged(known.select("node", "component")), "node", "left").select(
            "node", F.least("up", "component").alias("up")
        )
    parents = stored(parents, "parents")
    while True:
        above = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        placed = parents.join(_merged(above), "up").select("node", "up", "top")
        ends = placed.select(F.col("node").alias("b"), F.col("top").alias("low"))
        near = edges.join(_merged(ends), "b").groupBy(F.col("a").alias("node")).agg(F.min("low").alias("low"))
        seen = placed.join(_merged(near), "node")
        own = seen.select("node", F.least("top", "low").alias("low"), F.col("up").alias("was"))
        parent = seen.select(F.col("up").alias("node"), "low", F.lit(None).cast(own.schema["was"].dataType).alias("was"))
        moved = own.unionByName(parent).groupBy("node").agg(F.min("low").alias("up"), F.max("was").alias("was"))
        moved = stored(moved, "parents")
        parents = moved.select("node", "up")
        if moved.where("up <> was").isEmpty():
            return parents.select("node", F.col("up").alias("component"))


def _merged(side: DataFrame) -> DataFrame:
    """The side of a join for which no broadcast is built: over many rounds, those would pile up in
    the driver's memory."""
    return side.hint("merge")
