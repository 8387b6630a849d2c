"""Connected components of a graph that no single machine needs to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriescope.llm.common import shared_checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of longs -> (node, root): the smallest node each linked node reaches.

    Alternating large and small stars: every node hands its neighbours to its smallest neighbour
    until only stars are left; rounds grow with the logarithm of the longest chain. Nodes without
    an edge aren't in the result; loops, nulls and repeated edges are ignored; an empty input
    gives an empty result. Each round is checkpointed, so lost executors repeat one round only.
    """
    pairs = (
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a > b")
        .distinct()
    )
    pairs = shared_checkpoint(pairs)
    before = None
    while True:
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        pairs = shared_checkpoint(_small_star(_large_star(pairs)))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the smallest of its neighbours and itself."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Written first, so that the join with the many neighbours of a hub can be split.
    least = shared_checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them."""
    least = shared_checkpoint(pairs.groupBy("a").agg(F.min("b").alias("m")))
    moved = pairs.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
