"""What surfaces show about frames and runs: usage, texts, orders, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import columns as C
from framesift.plans.fold import greedy_fold


def backend_usage(frames: DataFrame) -> DataFrame:
    """How many frames each focus backend measured, refined ones counted with their first backend."""
    name = F.split_part("feature_backend", F.lit("+refined_"), F.lit(1))
    return frames.where(name != "").groupBy(name.alias("backend")).agg(F.count(F.lit(1)).alias("frames"))


def focus_backend(usage: DataFrame, primary: str = "cpu_portable") -> DataFrame:
    """One row: the backend a run is said to have used, from its usage."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("frames"))), F.lit(0))
    name = F.col("backend")
    counts = usage.agg(*[n(name == b).alias(b) for b in ("cuda", "metal", "cpu_avx2", "cpu_neon", "cpu_portable", "cpu_small_image")], n(name.startswith("cpu_")).alias("cpu"))
    chosen = F.lit(primary)
    for b, shown in reversed((("cpu_avx2", "cpu_avx2"), ("cpu_neon", "cpu_neon"), ("cpu_portable", "cpu_portable"), ("cpu_small_image", "cpu_portable"))):
        chosen = F.when(F.col(b) > 0, shown).otherwise(chosen)
    for b in ("metal", "cuda"):
        chosen = F.when(F.col(b) > 0, F.when(F.col("cpu") > 0, f"{b}_with_cpu_fallback").otherwise(b)).otherwise(chosen)
    return counts.select(chosen.alias("focus_backend"))


def cluster_ids(stacks: DataFrame) -> DataFrame:
    """burst_id and its stacks, in order. stacks: (burst_id, stack_id), a row for each stack."""
    return stacks.groupBy("burst_id").agg(F.sort_array(F.collect_list("stack_id")).alias("cluster_ids"))


def exif_summary(iso: Column, aperture: Column, shutter_s: Column, focal: Column, focal35: Column) -> Column:
    """The known values in one line."""
    shutter = F.nullif(C.shutter_text(shutter_s), F.lit(""))
    parts = (
        F.concat(F.lit("ISO "), iso.cast("string")), F.concat(F.lit("f/"), C.fixed(aperture, 1)), shutter, F.concat(C.fixed(focal, 1), F.lit(" mm")),
        F.concat(focal35.cast("string"), F.lit(" mm equivalent")),
    )
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) == 0, "no EXIF data").otherwise(F.array_join(known, "  ·  "))


def neighbours(frames: DataFrame) -> DataFrame:
    """Adds previous_id and next_id in rank order within the stack."""
    over = Window.partitionBy("stack_id").orderBy("rank")
    return frames.withColumns({"previous_id": F.lag("id").over(over), "next_id": F.lead("id").over(over)})


def manifest_order() -> list[Column]:
    return [F.col("burst_id"), F.col("stack_id"), F.col("rank"), F.col("directory"), F.col("prefix"), F.coalesce("seq", F.lit(-1)), F.col("stem")]


def workload(frames: Column, preview_edge: Column, refine_edge: Column, candidates: Column, workers: Column) -> Column:
    """Weighted megapixels that a scan will measure, for each worker."""
    return (frames * preview_edge * preview_edge + candidates * refine_edge * refine_edge) / 1e6 / F.greatest(workers, F.lit(1))


def throttle_step():
    """The fold's step over (stage, current, total, percent, at_ms): whether an update is shown, given the last one shown."""
    shown = None

    def step(row):
        nonlocal shown
        if row is None:
            shown = None
            return True
        stage, current, total, percent, at_ms = row
        ends = current is not None and total is not None and current >= total
        show = shown is None or stage != shown[0] or ends or percent >= shown[1] + 2 or at_ms - shown[2] >= 1000
        if show:
            shown = stage, percent, at_ms
        return show

    return step


def throttled(updates: DataFrame) -> DataFrame:
    """Of progress updates (scan_id, idx, stage, current, total, percent, at_ms) those that are shown: a stage that changes or
    ends, two percent more than the last shown, or a second after it.

    What was last shown depends on what was shown before, so updates of one scan are folded in order; they stream through.
    """
    inputs = ["stage", "current", "total", "percent", "at_ms"]
    return greedy_fold(updates, ["scan_id"], [F.col("idx")], throttle_step, inputs, "shown").where("shown").select("scan_id", "idx")


def timing_sums(timings: DataFrame) -> DataFrame:
    """Of (stage, elapsed_ms), a row for each item, the time, number and rate of each stage."""
    ms = F.sum("elapsed_ms")
    return timings.groupBy("stage").agg(ms.alias("total_ms"), F.count(F.lit(1)).alias("items"), F.when(ms > 0, F.count(F.lit(1)) * 1000.0 / ms).alias("items_per_s"))


def find_frames(frames: DataFrame, ids: list[str]) -> DataFrame:
    """The frames of these ids: a filter that reaches the files' statistics."""
    return frames.where(F.col("id").isin(ids))


def diagnostics(manifest: dict, workers: int = 1) -> dict:
    """What a run used, from its manifest; fields that older manifests leave empty take what was always used then."""
    acceleration, options = manifest.get("acceleration") or {}, manifest.get("options") or {}
    focus = acceleration.get("focus_backend") or acceleration.get("selected") or ""
    parallel = acceleration.get("parallelism_backend") or "spark"
    number = max(acceleration.get("parallelism_workers") or 0, options.get("workers") or 1, workers)
    return {
        "acceleration": f"{focus} + {parallel} ({number})", "focus_backend": focus, "parallelism_backend": parallel, "parallelism_workers": number,
        "detector": (manifest.get("detector") or {}).get("selected", ""), "raw_decoder": (manifest.get("decoders") or {}).get("raw_strategy", ""),
    }


def run_library(runs: DataFrame, files: DataFrame, moves: DataFrame) -> DataFrame:
    """Known runs (path, name, created_ms), each once, with size and whether moves are active; the newest first.

    files: (run_path, size); moves: (run_path, restored_at).
    """
    sizes = files.groupBy(F.col("run_path").alias("path")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    active = moves.where("restored_at IS NULL").select(F.col("run_path").alias("path"), F.lit(True).alias("has_moves")).distinct()
    once = runs.groupBy("path").agg(F.max("name").alias("name"), F.max("created_ms").alias("created_ms"))
    joined = once.join(sizes, "path", "left").join(active, "path", "left")
    filled = joined.withColumns({"files": F.coalesce("files", F.lit(0)), "bytes": F.coalesce("bytes", F.lit(0)), "has_moves": F.coalesce("has_moves", F.lit(False))})
    return filled.orderBy(F.col("created_ms").desc(), F.col("name").desc())


def viewable(extension: Column) -> Column:
    """Whether a browser shows such files itself."""
    return F.lower(extension).isin(C.VIEWABLE)
