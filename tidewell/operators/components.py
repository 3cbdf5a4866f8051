"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.storage import stored


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Large-star and small-star steps in turn, until the edges no longer change: each
    step needs minima per node and one equi-join, so no neighbourhood is gathered, and
    the number of rounds grows with the logarithm of the longest path. Each round is a
    stored table, so a lost executor costs one round at most. Loops and null ends are
    ignored; an empty table gives an empty result.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    kept = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    stars = stored(edges.filter(kept).select(high.alias("a"), low.alias("b")).distinct(), "edges")
    before = None
    while True:
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if state == before or state[0] == 0:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(nearest, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = stored(small.unionByName(nearest.select("a", F.col("m").alias("b"))).distinct(), "stars")
