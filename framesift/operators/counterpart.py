"""Which files on a second card belong to rejected frames of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.operators import moves


def plan_counterparts(primary: DataFrame, card: DataFrame, active: DataFrame) -> DataFrame:
    """status for each rejected frame of ``primary`` (id, stem, has_raw, has_compressed, operation_action).

    A frame that has only raw files expects a compressed counterpart in ``card`` (card_id, stem, has_raw, has_compressed)
    and the other way round; with both or neither it is skipped_paired. The first that applies: already_applied (in
    ``active``), conflicting (its stem isn't unique in the primary, case aside, over all its frames), unmatched,
    ambiguous (several candidates), matched, with the candidate's id.
    """
    stem = F.lower("stem")
    counts = primary.groupBy(stem.alias("key")).agg(F.count(F.lit(1)).alias("same_stem"))
    expects = F.when(F.col("has_raw") & ~F.col("has_compressed"), "compressed").when(F.col("has_compressed") & ~F.col("has_raw"), "raw")
    rejected = primary.where(F.col("operation_action") == "reject").select("id", "stem", stem.alias("key"), expects.alias("expected_kind"))
    kinds = F.explode(F.array_compact(F.array(F.when(F.col("has_raw"), "raw"), F.when(F.col("has_compressed"), "compressed"))))
    offers = card.select("card_id", stem.alias("key"), kinds.alias("expected_kind")).groupBy("key", "expected_kind").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("card_id").alias("card_id")
    )
    done = active.select(F.col("asset_id").alias("id"), F.lit(True).alias("applied")).distinct()
    joined = rejected.join(counts, "key").join(offers, ["key", "expected_kind"], "left").join(done, "id", "left")
    status = (
        F.when(F.col("expected_kind").isNull(), "skipped_paired")
        .when(F.col("applied"), "already_applied")
        .when(F.col("same_stem") > 1, "conflicting")
        .when(F.col("candidates").isNull(), "unmatched")
        .when(F.col("candidates") > 1, "ambiguous")
        .otherwise("matched")
    )
    return joined.withColumn("status", status).select("id", "stem", "expected_kind", "status", F.when(status == "matched", F.col("card_id")).alias("card_id"))


def status_lists(plan: DataFrame) -> DataFrame:
    """For each status how many frames, and their distinct stems in order."""
    return plan.groupBy("status").agg(F.count(F.lit(1)).alias("frames"), F.sort_array(F.collect_set("stem")).alias("stems"))


def matches_in_order(plan: DataFrame) -> DataFrame:
    """The matched frames by stem, case aside; equal ones by id."""
    return plan.where("status = 'matched'").orderBy(F.lower("stem"), "id")


def asset_files(assets: DataFrame) -> DataFrame:
    """A row for each different file of each asset (asset_id, files, sidecars: arrays of path, rel_path, size): picture files and
    sidecars together, without repetition; nulls are no files."""
    both = F.array_union(F.coalesce("files", F.array().cast(assets.schema["files"].dataType)), F.coalesce("sidecars", F.array().cast(assets.schema["files"].dataType)))
    one = F.explode(F.array_compact(both)).alias("file")
    return assets.select("asset_id", one).select("asset_id", F.col("file.path").alias("source"), F.col("file.rel_path").alias("rel_path"), F.col("file.size").alias("size"))


def transfer_plan(assets: DataFrame, root: str) -> DataFrame:
    """asset_id, source, rel_path, size and target under root of all files of these assets, no two targets equal."""
    return moves.plan_targets(asset_files(assets), root, F.struct("asset_id", "rel_path"))


def counterpart_transfers(plan: DataFrame, card: DataFrame, root: str) -> DataFrame:
    """What moves if a plan is carried out: the files and sidecars on the second card of every match, under the id of the frame
    that they belong to. card has card_id, files and sidecars."""
    matched = plan.where("status = 'matched'").select(F.col("id").alias("asset_id"), "card_id")
    return transfer_plan(matched.join(card.select("card_id", "files", "sidecars"), "card_id").drop("card_id"), root)
