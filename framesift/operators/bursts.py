"""Bursts: runs of frames that follow each other closely, within a span that counts from the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.operators.assets import DISCOVERY_ORDER, with_order_keys
from framesift.options import ScanOptions
from framesift.plans.fold import greedy_fold, number_starts
from framesift.plans.staging import stage

KEYS = ["directory", "prefix"]


def adjacent_splits(frames: DataFrame, options: ScanOptions) -> DataFrame:
    """Adds hard_split: the first of a (directory, prefix), or too long after the frame before it in time or number.

    Times are compared only where both are known and either way round, since order is by number first.
    """
    order = Window.partitionBy(*KEYS).orderBy("seq_key", "time_key", "stem")
    gap = F.abs(F.col("time_ms") - F.lag("time_ms").over(order)) > options.max_time_gap_ms
    jump = (F.col("seq") - F.lag("seq").over(order)) > options.max_seq_gap
    first = F.row_number().over(order) == 1
    keyed = with_order_keys(frames)
    return keyed.withColumns({"hard_split": first | F.coalesce(gap, F.lit(False)) | F.coalesce(jump, F.lit(False)), "prev_ms": F.lag("time_ms").over(order)})


def span_step(span_ms: int):
    """The fold's step: a burst starts at a hard split, or where a frame is more than the span from the burst's first."""

    def make():
        start = None

        def step(row):
            nonlocal start
            if row is None:
                start = None
                return True
            hard, now, before = row
            new = hard or (now is not None and before is not None and start is not None and abs(now - start) > span_ms)
            if new:
                start = now
            return new

        return step

    return make


def split_bursts(frames: DataFrame, options: ScanOptions) -> DataFrame:
    """Frames (directory, prefix, seq, time_ms, stem, ...) with burst_start, whether a burst begins there, and pos, a frame's
    place in its (directory, prefix).

    What two neighbours decide is a window, and cuts a (directory, prefix) into islands. Only the span, which counts from
    where the burst began, must be folded over the rows in order, from the start of each island. An island whose times lie
    within the span can't be split by it and is not folded; the others are dealt out island by island, so that a
    folder with most of the frames is work for many tasks.
    """
    island = Window.partitionBy(*KEYS, "island")
    order = Window.partitionBy(*KEYS).orderBy("seq_key", "time_key", "stem")
    hard = adjacent_splits(frames, options).withColumns({"island": F.sum(F.col("hard_split").cast("bigint")).over(order), "pos": F.row_number().over(order).cast("bigint")})
    cut = stage(hard.withColumn("__long", F.coalesce(F.max("time_ms").over(island) - F.min("time_ms").over(island) > options.max_cluster_span_ms, F.lit(False))), "islands")
    short = cut.where(~F.col("__long")).drop("__long", "island").withColumn("burst_start", F.col("hard_split"))
    long = cut.where("__long").drop("__long")
    folded = greedy_fold(long, [*KEYS, "island"], [F.col("pos")], span_step(options.max_cluster_span_ms), ["hard_split", "time_ms", "prev_ms"], "burst_start")
    return short.unionByName(folded.drop("island"))


def number_bursts(split: DataFrame) -> DataFrame:
    """Adds burst_id, 1, 2, ... over all bursts in order of directory, prefix and place."""
    return number_starts(split, [F.col("directory"), F.col("prefix"), F.col("pos")], "burst_start", "burst_id")


def bursts(frames: DataFrame, options: ScanOptions) -> DataFrame:
    return number_bursts(split_bursts(frames, options))


def summarize(numbered: DataFrame, key: str = "burst_id") -> DataFrame:
    """One row for each burst or stack: its frames, and the first and last known time."""
    return numbered.groupBy(key).agg(
        F.min("directory").alias("directory"), F.min("prefix").alias("prefix"), F.count(F.lit(1)).alias("frames"), F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms")
    )


def discovery_order() -> list[Column]:
    return [F.col(c) for c in DISCOVERY_ORDER]
