"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.plans.staging import stage


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of ``edges`` (a, b: bigint); no rows for no edges.

    Loops and repeated edges do no harm; nulls have no edge. A round joins edges to one minimum for each node. Minima
    are taken before the shuffle, and the joins are plain ones of two written tables, so that adaptive execution can
    split the rows of a node with very many edges. Rounds grow with the logarithm of the longest path.
    """
    high, low = F.greatest("a", "b"), F.least("a", "b")
    now = stage(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = stage(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        parent = stage(large.groupBy("a").agg(F.min("b").alias("m")), "parent")
        small = large.join(parent, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stage(small.unionByName(parent.select("a", F.col("m").alias("b"))).distinct(), "edges")
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
