"""Distances between descriptors, and complete-link stacks of near duplicates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    """The sum of an array of whole numbers."""
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def correlation_distance(a: Column, b: Column) -> Column:
    """(1 - correlation) / 2 of two arrays of bytes; the mean difference over 255 where one of them is constant."""
    n = F.size(a)
    cov = n * dot(a, b) - total(a) * total(b)
    va, vb = n * dot(a, a) - total(a) * total(a), n * dot(b, b) - total(b) * total(b)
    flat = total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / (255.0 * n)
    rho = cov / (F.sqrt(va.cast("double")) * F.sqrt(vb.cast("double")))
    smooth = F.least(F.greatest((1 - F.least(F.greatest(rho, F.lit(-1.0)), F.lit(1.0))) * 0.5, F.lit(0.0)), F.lit(1.0))
    return F.when((n != F.size(b)) | (n == 0), 1.0).when((va == 0) | (vb == 0), flat).otherwise(smooth)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, 1 where one of them is zero."""
    aa, bb = dot(a, a), dot(b, b)
    smooth = 1 - dot(a, b) / (F.sqrt(aa.cast("double")) * F.sqrt(bb.cast("double")))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (aa == 0) | (bb == 0), 1.0).otherwise(F.least(F.greatest(smooth, F.lit(0.0)), F.lit(1.0)))


def mask_counts(a: Column, b: Column) -> tuple[Column, Column]:
    either = total(F.zip_with(a, b, lambda x, y: ((x != 0) | (y != 0)).cast("bigint")))
    both = total(F.zip_with(a, b, lambda x, y: ((x != 0) & (y != 0)).cast("bigint")))
    return both, either


def mask_distance(a: Column, b: Column) -> Column:
    both, either = mask_counts(a, b)
    return F.when(either < 8, 1.0).otherwise(1 - both / F.greatest(either, F.lit(1)))


def mask_reliability(a: Column, b: Column) -> Column:
    _, either = mask_counts(a, b)
    return F.when(either < 8, 0.35).otherwise(F.least(F.greatest(F.sqrt(either / 80.0), F.lit(0.35)), F.lit(1.0)))


def combined(luma: Column, edges: Column, mask: Column, reliability: Column, overall: Column, conf_a: Column, conf_b: Column) -> tuple[Column, Column, Column]:
    """(distance, confidence, subject distance) from the parts."""
    subject = 0.42 * mask + 0.38 * edges + 0.20 * luma
    confidence = F.least(F.greatest(F.least(conf_a, conf_b) * reliability, F.lit(0.0)), F.lit(1.0))
    distance = F.when(confidence >= 0.25, 0.92 * subject + 0.08 * overall).otherwise(0.70 * subject + 0.30 * overall)
    return F.least(F.greatest(distance, F.lit(0.0)), F.lit(1.0)), confidence, subject


def band_pairs(frames: DataFrame, group: str, pos: str, band: int) -> DataFrame:
    """Pairs (a, b) of frames in the same group whose places differ by 1 to ``band``.

    Each frame looks up its next ones by place, an equi-join of band times as many rows, instead of joining a group with itself.
    """
    left = frames.select(F.struct("*").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(band))).alias("step"))
    left = left.select("a", F.col(f"a.{group}").alias("__g"), (F.col(f"a.{pos}") + F.col("step")).alias("__p"))
    right = frames.select(F.struct("*").alias("b"), F.col(group).alias("__g"), F.col(pos).alias("__p"))
    return left.join(right, ["__g", "__p"]).select("a", "b")


# -- stacks ------------------------------------------------------------------------------------------------------------


def array_correlation(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``correlation_distance`` of one descriptor to each row of many, by whole-number sums."""
    a, b, n = one.astype(np.int64), many.astype(np.int64), one.shape[-1]
    cov = n * (b @ a) - b.sum(axis=1) * a.sum()
    va, vb = n * (a @ a) - a.sum() ** 2, n * (b * b).sum(axis=1) - b.sum(axis=1) ** 2
    flat = np.abs(b - a).sum(axis=1) / (255.0 * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = cov / (np.sqrt(float(va)) * np.sqrt(vb.astype(float)))
    return np.where((va == 0) | (vb == 0), flat, np.clip((1 - np.clip(rho, -1, 1)) * 0.5, 0, 1))


Compare = Callable[[tuple, list[tuple]], tuple[np.ndarray, np.ndarray]]

STACK_FIELDS = "stack_start boolean, nearest_distance double, duplicate_confidence double, pose_novelty double, stack_confidence double, max_distance double"


def stack_frames(frames: DataFrame, keys: list[str], order: list[Column], inputs: list[str], compare: Compare, guard: Callable[[tuple, tuple], bool], threshold: float) -> DataFrame:
    """Complete-link stacks along the order within ``keys``: a frame joins the current stack if ``guard`` lets it follow
    the frame before it and it is within ``threshold`` of every frame in the stack; else it begins one.

    ``compare(row, rows)`` gives distances and confidences. Only the current stack is held and each frame is compared
    with its members alone, so no other pair is ever made. Each frame gets the STACK_FIELDS: its distance to the nearest
    member (the earliest on ties; 1 alone), its duplicate confidence and novelty, and its stack's mean confidence and
    largest distance.
    """
    columns = frames.columns

    def close(rows, matrix):
        n = len(rows)
        if n == 1:
            return [(True, 1.0, 0.0, 1.0, 0.0, 0.0)]
        distance, confidence = np.full((n, n), np.inf), np.zeros((n, n))
        for i, (d, c) in enumerate(matrix):
            distance[i, : len(d)] = distance[: len(d), i] = d
            confidence[i, : len(c)] = confidence[: len(c), i] = c
        at = distance.argmin(axis=1)
        nearest = distance[np.arange(n), at]
        ratio = np.clip(nearest / max(threshold, 1e-9), 0, 1)
        duplicate = confidence[np.arange(n), at] * (1 - 0.35 * ratio)
        largest = float(np.where(np.isfinite(distance), distance, 0).max())
        return [(i == 0, float(nearest[i]), float(duplicate[i]), float(ratio[i]), float(duplicate.mean()), largest) for i in range(n)]

    def run(batches):
        names = [f.split()[0] for f in STACK_FIELDS.split(", ")]
        last, rows, matrix, held = None, [], [], []

        def flush():
            out = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            found = [pa.array(c) for c in zip(*close(rows, matrix))]
            rows.clear(), matrix.clear(), held.clear()
            return pa.RecordBatch.from_arrays([*out.columns, *found], [*columns, *names])

        for batch in batches:
            key_rows = list(zip(*[batch.column(columns.index(k)).to_pylist() for k in keys]))
            for i, row in enumerate(zip(*[batch.column(columns.index(c)).to_pylist() for c in inputs])):
                fits, measured = False, (np.zeros(0), np.zeros(0))
                if rows and key_rows[i] == last and guard(rows[-1], row):
                    measured = compare(row, rows)
                    fits = bool((measured[0] <= threshold).all())
                if rows and not fits:
                    yield flush()
                    measured = (np.zeros(0), np.zeros(0))
                last = key_rows[i]
                rows.append(row)
                matrix.append(measured)
                held.append(batch.slice(i, 1))
        if rows:
            yield flush()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema.fields)
    return frames.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, f"{fields}, {STACK_FIELDS}")
