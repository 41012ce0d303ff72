"""Decisions of the user over suggestions: final actions, filters, routing and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import columns as C


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key in order. Written as a maximum of structs, which is taken before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    place = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    return rows.groupBy(key).agg(F.max(F.struct(*place, *rest)).alias("r")).select(key, *[F.col(f"r.{c}") for c in rest])


def upsert_decisions(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Decisions (asset_id, decision, note, updated_at) after updates; of several for an asset the latest counts, and
    rows with neither decision nor note go."""
    both = current.withColumn("__new", F.lit(0)).unionByName(updates.withColumn("__new", F.lit(1)))
    kept = latest(both, "asset_id", [F.col("__new"), F.col("updated_at")])
    return kept.where(F.col("decision").isNotNull() | (F.trim(F.coalesce("note", F.lit(""))) != "")).drop("__new")


def keep_for_run(decisions: DataFrame, review_run: str, manifest_run: str) -> DataFrame:
    """A review state counts only for the run it was made for."""
    return decisions if review_run == manifest_run else decisions.limit(0)


def with_decisions(frames: DataFrame, decisions: DataFrame, key: str = "id") -> DataFrame:
    """Frames with decision, note, final_action (errors stay errors) and operation_action (errors are to be reviewed)."""
    once = latest(decisions, "asset_id", [F.col("updated_at")]).select(F.col("asset_id").alias(key), "decision", "note")
    joined = frames.join(once, key, "left")
    return joined.withColumns({"final_action": C.final_action(F.col("decision"), F.col("action")), "operation_action": C.operation_action(F.col("decision"), F.col("action"))})


def export_file(final_action: Column) -> Column:
    """The CSV a row goes to besides the one of all; errors are among those to review."""
    return F.when(final_action == "keep", "keepers").when(final_action == "reject", "rejects").otherwise("review")


def movable_rejects(frames: DataFrame, journal: DataFrame, key: str = "id") -> DataFrame:
    """Rejected frames without an active move."""
    moved = journal.where(F.col("restored_at").isNull()).select(F.col("asset_id").alias(key)).distinct()
    return frames.where(F.col("operation_action") == "reject").join(moved, key, "left_anti")


def review_filter(frames: DataFrame, mode: str, text: str = "") -> DataFrame:
    """Frames of a mode (all, keep, review, reject, moved, multi) whose path and stem contain the text, case aside."""
    wanted = {"all": F.lit(True), "moved": F.col("moved"), "multi": F.col("stack_size") > 1}.get(mode, F.col("final_action") == mode)
    found = frames.where(wanted)
    if text.strip():
        found = found.where(F.contains(F.lower(F.concat_ws(" ", "rel_path", "stem")), F.lit(text.strip().lower())))
    return found


def collapsed_stacks(frames: DataFrame, limit: int | None = None) -> DataFrame:
    """Stacks with whether they show collapsed (all kept); open ones first, then by id, at most ``limit``."""
    stacks = frames.groupBy("stack_id").agg(F.every(F.col("final_action") == "keep").alias("collapsed"), F.count(F.lit(1)).alias("frames"))
    ordered = stacks.orderBy("collapsed", "stack_id")
    return ordered if limit is None else ordered.limit(limit)


def decision_counts(frames: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("final_action") == a).alias(a)
    return frames.agg(*[count(a) for a in ("keep", "review", "reject", "error")], F.count_if("moved").alias("moved"))


def metadata_varies(frames: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """For each group and field whether its known values differ, and whether any whole record differs from another."""
    record = F.struct(*fields)
    return frames.groupBy(group).agg(
        *[(F.count_distinct(F.col(f)) > 1).alias(f"{f}_varies") for f in fields], (F.count_distinct(record) > 1).alias("record_varies")
    )
