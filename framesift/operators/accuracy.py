"""Results held against labelled pairs and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_accuracy(pairs: DataFrame, stacks: DataFrame) -> DataFrame:
    """must_link and cannot_link: the shares of pairs (a, b, must) put together and apart; pair_accuracy over both.

    Labels are few next to frames: two equi-joins look up both ends in ``stacks`` (id, stack_id).
    """
    one = stacks.select(F.col("id").alias("a"), F.col("stack_id").alias("stack_a"))
    two = stacks.select(F.col("id").alias("b"), F.col("stack_id").alias("stack_b"))
    judged = pairs.join(one, "a").join(two, "b").withColumn("right", (F.col("stack_a") == F.col("stack_b")) == F.col("must"))
    share = lambda when: F.avg(F.when(when, F.col("right").cast("double")))
    return judged.agg(
        F.count(F.lit(1)).alias("pairs"), share(F.col("must")).alias("must_link"), share(~F.col("must")).alias("cannot_link"), share(F.lit(True)).alias("pair_accuracy")
    )


def phase_coverage(phases: DataFrame, frames: DataFrame) -> DataFrame:
    """For each phase (name, start, end) whether a frame within it is kept or to be reviewed.

    frames: (idx, final_action). Ranges are cut into the blocks of BLOCK places they touch, so it is an equi-join with a
    filter, whatever the sizes.
    """
    block = 1_000
    cut = phases.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))))
    placed = frames.select("idx", "final_action", F.floor(F.col("idx") / block).alias("block"))
    met = cut.join(placed, "block", "left").where(F.col("idx").isNull() | F.col("idx").between(F.col("start"), F.col("end")))
    hits = met.groupBy("name").agg(F.bool_or(F.col("final_action").isin("keep", "review")).alias("hit"))
    return phases.join(hits, "name", "left").select("name", F.coalesce("hit", F.lit(False)).alias("covered"))
