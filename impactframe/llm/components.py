"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactframe.llm.tables import Scratch

#: Large-star and small-star rounds after which something must be wrong; a graph needs about log2 of its diameter.
MOST_ROUNDS = 100


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of the edges (a, b); the component is its smallest node.

    Large star and small star in turn: every node's larger, then smaller neighbours are tied to its smallest
    neighbour, until nothing changes. A round only needs minima by node and joins, so a hub with very many
    neighbours is never gathered.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    pairs = scratch.write(pairs.distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = pairs.select(F.col("high").alias("u"), F.col("low").alias("v")).union(pairs.select("low", "high"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low")).distinct()
        smallest = large.groupBy("high").agg(F.min("low").alias("m"))
        tied = large.join(smallest, "high").where("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        pairs = scratch.write(tied.union(smallest).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    # A star: every node but the smallest has one pair, with the smallest.
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        pairs.select("low", "low").distinct()
    )
