"""The whole scan as one chain of frames: files, assets, measures, bursts, stacks, refinement, ranks, suggestions."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import columns as C
from framesift.functions import kernels
from framesift.operators import assets, bursts, ranking, similarity
from framesift.options import ScanOptions
from framesift.plans.fold import number_starts
from framesift.plans.staging import stage
from framesift.progress import Reporter
from framesift.sources import decoders, files, images

DESCRIPTOR = ["global_luma", "subject_luma", "subject_edges", "subject_mask", "subject_confidence", "subject_area_fraction"]
METRICS = list(kernels.Metrics().as_dict())


def compare_rows(row: tuple, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    one = images.describe_row(row)
    found = [kernels.compare(images.describe_row(r), one) for r in rows]
    return np.array([f[0] for f in found]), np.array([f[1] for f in found])


def same_scene(max_hash_gap: int):
    """Whether a frame may follow another in a stack: neither has an error and their hashes are close."""

    def guard(before: tuple, row: tuple) -> bool:
        return before[7] is None and row[7] is None and kernels.hash_distance(before[6] or "", row[6] or "") <= max_hash_gap

    return guard


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """A folder that the driver sees is walked, for its creation times; any other store is listed by Spark."""
    plain = root.removeprefix("file://")
    return files.list_local(spark, plain) if os.path.isdir(plain) else files.list_store(spark, root)


def load_rasters(spark: SparkSession, root: str, external: list | None, candidates: DataFrame | None = None) -> DataFrame:
    """Pictures as Spark reads them; with external decoders also what it can't read."""
    if external is not None:
        return decoders.load_with_fallback(spark, root, external, candidates)
    found = images.load_images(spark, root)
    return found if candidates is None else found.join(candidates.select("path"), "path", "left_semi")


def measured_assets(spark: SparkSession, root: str, options: ScanOptions, external: list | None = None, detector: images.Detector | None = None) -> DataFrame:
    """Assets with their times and the measures of their representative; EXIF time counts before file times."""
    listed = assets.classify_files(list_files(spark, root), root)
    grouped = assets.group_assets(listed).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "representative"))
    scored = images.score_images(load_rasters(spark, root, external), options.preview_size, options.detector, detector)
    exif = images.load_exif(spark, root).select("path", "captured_at_ms", "iso", "aperture", "shutter_s", "focal_mm", "focal35_mm")
    joined = grouped.join(scored, "path", "left").join(exif, "path", "left")
    missing = F.when(F.col("feature_backend").isNull(), "no decoder for this file").otherwise(F.col("error"))
    defaults = {m: F.coalesce(m, F.lit(v)) for m, v in kernels.Metrics().as_dict().items()}
    timed = joined.withColumns({
        **defaults, "error": missing, "feature_backend": F.coalesce("feature_backend", F.lit("none")),
        "capture_source": C.capture_source(F.col("captured_at_ms"), F.col("created_ms"), F.col("modified_ms")),
        "time_ms": F.coalesce("captured_at_ms", "created_ms", "modified_ms"), "n_files": F.size("files"),
        "subject_confidence": F.coalesce("subject_confidence", F.lit(0.0)), "subject_area_fraction": F.coalesce("subject_area_fraction", F.lit(1.0)),
    })
    return stage(timed, "measured")


def stack_bursts(numbered: DataFrame, options: ScanOptions) -> DataFrame:
    """Adds the stack's fields and stack_id, 1, 2, ... in order of bursts."""
    rows = similarity.stack_frames(numbered, ["burst_id"], [F.col("pos")], [*DESCRIPTOR, "dhash", "error"], compare_rows, same_scene(options.max_hash_gap), options.max_duplicate_distance)
    return number_starts(rows, [F.col("burst_id"), F.col("pos")], "stack_start", "stack_id")


def scan(
    spark: SparkSession, root: str, options: ScanOptions = ScanOptions(), reporter: Reporter | None = None,
    external: list | None = None, detector: images.Detector | None = None,
) -> DataFrame:
    """One row for each frame under root, with burst, stack, rank, action, reason and explanations.

    Stacks are made from the first measures. The best of each stack are then measured again at a higher resolution, and
    ranks come from what is known then: in a stack, refined and other frames are set against each other. ``reporter`` hears of
    every stage, times it, and may call the scan off between two. ``external`` are decoders for what Spark can't read, and
    ``detector`` is asked where the options say ml.
    """
    options, reporter = options.normalized(), reporter or Reporter()
    reporter.emit("preparing", 1, 1)
    measured = reporter.stage("analyzing", lambda: measured_assets(spark, root, options, external, detector), lambda df: df.count())
    numbered = reporter.stage("grouping", lambda: stage(stack_bursts(bursts.bursts(measured, options), options), "stacks"), lambda df: df.count())
    if options.refines:

        def refine() -> DataFrame:
            first = ranking.rank_stacks(numbered, options)
            chosen = stage(ranking.refinement_candidates(first, options).select("id", "path"), "candidates")
            fresh = images.refine_images(load_rasters(spark, root, external, chosen), chosen, options.refine_size, options.detector, detector)
            return stage(ranking.finite(fresh, METRICS), "refined")

        refined = reporter.stage("refining", refine, lambda df: df.count())
        stacked = ranking.update_metrics(numbered, refined, METRICS)
    else:
        stacked = numbered.withColumn("refine_size", F.lit(None).cast("int"))
    reporter.emit("ranking", 0, 1)
    ranked = ranking.suggest(ranking.rank_stacks(stacked, options), options)
    told = ranked.withColumns({"refine_feature_ms": F.when(F.col("refine_size").isNotNull(), F.col("feature_ms")).otherwise(0.0), "refine_decode_ms": F.lit(0.0)})
    return told.withColumn("explanations", ranking.explanations()).drop(*DESCRIPTOR[:4])
