"""Ranking in a stack, and what to suggest for each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import columns as C
from framesift.options import ScanOptions

FOCUS = ("sharpness", "tenengrad", "subject_sharpness", "subject_tenengrad")


def min_max(value: Column, over: Window) -> Column:
    """ln(1 + value) between the least and most in the stack, 0.5 where all are equal."""
    log = F.log1p(F.greatest(value, F.lit(0.0)))
    low, high = F.min(log).over(over), F.max(log).over(over)
    return F.when(high - low < 1e-9, 0.5).otherwise((log - low) / (high - low))


def sharp_component(norms: dict[str, Column], subject_confidence: Column) -> Column:
    whole = 0.70 * norms["sharpness"] + 0.30 * norms["tenengrad"]
    subject = 0.70 * norms["subject_sharpness"] + 0.30 * norms["subject_tenengrad"]
    return F.when(subject_confidence >= 0.3, 0.72 * subject + 0.28 * whole).otherwise(whole)


def quality_score(sharp: Column) -> Column:
    """0 for frames with an error."""
    border = F.least(F.col("border_energy_fraction") / 0.35, F.lit(1.0))
    score = 0.60 * sharp + 0.18 * F.col("completeness") + 0.10 * F.col("contrast") + 0.07 * F.col("object_confidence") + 0.05 * F.col("exposure_score") - 0.08 * border
    return F.when(F.col("error").isNotNull(), 0.0).otherwise(score)


def keep_count(size: Column, requested: int | None) -> Column:
    return F.lit(1) if requested is None else F.least(F.lit(max(requested, 1)), F.greatest(size, F.lit(1)))


def rank_stacks(frames: DataFrame, options: ScanOptions, stack: str = "stack_id", digits: int | None = None) -> DataFrame:
    """Adds score, rank, stack_size, keep_count, keep_threshold and best_id. Ties keep the order of pos.

    ``digits`` rounds scores before they are compared. All windows share one partitioning by stack.
    """
    over = Window.partitionBy(stack)
    scored = frames.withColumns({f"n_{c}": min_max(F.col(c), over) for c in FOCUS})
    score = quality_score(sharp_component({c: F.col(f"n_{c}") for c in FOCUS}, F.col("subject_confidence")))
    scored = scored.withColumn("score", score if digits is None else F.round(score, digits))
    ranked = scored.withColumns({"rank": F.row_number().over(over.orderBy(F.col("score").desc(), "pos")), "stack_size": F.count(F.lit(1)).over(over)})
    kept = ranked.withColumn("keep_count", keep_count(F.col("stack_size"), options.keepers_per_cluster).cast("int"))
    return kept.withColumns({
        "keep_threshold": F.max(F.when(F.col("rank") == F.col("keep_count"), F.col("score"))).over(over),
        "best_id": F.max(F.when(F.col("rank") == 1, F.col("id"))).over(over),
    })


def suggest(ranked: DataFrame, options: ScanOptions, stack: str = "stack_id") -> DataFrame:
    """Adds action and reason, the first that applies: error, alone, best, uncertain, near tie, duplicate."""
    cases = [
        (F.col("error").isNotNull(), "error", F.lit("decode error")),
        (F.col("stack_size") == 1, "keep", F.lit("distinct frame")),
        (F.col("rank") <= F.col("keep_count"), "keep", F.format_string("best quality in stack %d", F.col(stack))),
        (F.col("duplicate_confidence") < options.min_duplicate_confidence, "review", F.format_string("similarity is uncertain in stack %d", F.col(stack))),
        (F.col("score") >= F.col("keep_threshold") - options.near_tie, "review", F.format_string("near quality tie in stack %d", F.col(stack))),
    ]
    action, reason = F.lit("reject"), F.format_string("high-confidence duplicate in stack %d", F.col(stack))
    for when, name, why in reversed(cases):
        action, reason = F.when(when, name).otherwise(action), F.when(when, why).otherwise(reason)
    return ranked.withColumns({"action": action, "reason": reason})


def explanations(stack: str = "stack_id") -> Column:
    """The lines that say why, as an array; what doesn't apply is left out. Errors have the error alone."""
    c, n = F.col, lambda name, digits: C.fixed(F.col(name), digits)
    # The sentences, which exports and their readers share
    lines = F.array_compact(
        F.array(
            F.format_string("Ranked %d of %d in near-duplicate stack %d; keeper count is %d.", c("rank"), c("stack_size"), c(stack), c("keep_count")),
            F.format_string(
                "Burst %d; subject confidence %s, nearest visual distance %s, duplicate confidence %s.",
                c("burst_id"), n("subject_confidence", 2), n("nearest_distance", 3), n("duplicate_confidence", 2),
            ),
            F.format_string("Whole-frame sharpness %s; subject sharpness %s; contrast %s.", n("sharpness", 1), n("subject_sharpness", 1), n("contrast", 2)),
            F.format_string("Completeness %s; border saliency %s indicates how much subject-like detail touches frame edges.", n("completeness", 2), n("border_energy_fraction", 2)),
            F.format_string("Exposure score %s; clipped pixels %s%%.", n("exposure_score", 2), C.fixed(c("clipped_fraction") * 100, 2)),
            F.when(
                c("refine_feature_ms") > 0,
                F.format_string("Quality metrics were refined at higher resolution; refinement decode %s ms, feature scoring %s ms.", n("refine_decode_ms", 1), n("refine_feature_ms", 1)),
            ),
            F.when(c("n_files") > 1, F.format_string("Decision applies to %d same-basename files, such as RAW+JPEG pairs.", c("n_files"))),
        )
    )
    return F.when(c("error").isNotNull(), F.array("error")).otherwise(lines)


def refinement_candidates(ranked: DataFrame, options: ScanOptions) -> DataFrame:
    """The frames to score again at a higher resolution: the best of each stack of two or more, errors apart."""
    if not options.refines:
        return ranked.limit(0)
    budget = F.least(F.greatest(F.lit(options.refine_candidates), F.col("keep_count")), F.col("stack_size"))
    return ranked.where((F.col("stack_size") > 1) & (F.col("rank") <= budget) & F.col("error").isNull())


def finite(refined: DataFrame, metrics: list[str]) -> DataFrame:
    """The rows whose measures are all numbers: an infinite or undefined one would upset its stack's scales."""
    ok = F.lit(True)
    for m in metrics:
        if refined.schema[m].dataType.simpleString() == "double":
            ok = ok & (F.abs(F.col(m)) < float("inf"))  # false for infinity; not a number is greater than all
    return refined.where(F.coalesce(ok, F.lit(False)))


def update_metrics(frames: DataFrame, refined: DataFrame, metrics: list[str], key: str = "id") -> DataFrame:
    """Frames with the metrics of ``refined`` (key, metrics, refine_size) where it has them; a failed refinement is no row there."""
    fresh = refined.select(key, "refine_size", *[F.col(m).alias(f"__{m}") for m in metrics])
    joined = frames.join(fresh, key, "left")
    backend = F.when(F.col("refine_size").isNotNull(), F.concat(F.col("feature_backend"), F.format_string("+refined_%d", F.col("refine_size")))).otherwise(F.col("feature_backend"))
    return joined.withColumns({**{m: F.coalesce(f"__{m}", m) for m in metrics}, "feature_backend": backend}).drop(*[f"__{m}" for m in metrics])


def action_summary(frames: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(f"{a}_count")
    return frames.agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("stack_id").alias("stacks"), *[count(a) for a in ("keep", "review", "reject", "error")])
