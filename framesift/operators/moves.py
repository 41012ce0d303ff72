"""The move journal and plans of moves; the moving itself is in ``framesift.sources.transfers``."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTIVE = "restored_at IS NULL"


def move_status(journal: DataFrame) -> DataFrame:
    """For each source set: the assets with active moves, in order, files, bytes and folders they are in."""
    return journal.where(ACTIVE).groupBy("source_set").agg(
        F.sort_array(F.collect_set("asset_id")).alias("asset_ids"),
        F.count(F.lit(1)).alias("files"),
        F.sum("size").alias("bytes"),
        F.count_distinct(F.regexp_extract("destination", r"(?s)^(.*)/[^/]*\z", 1)).alias("folders"),
    )


def resolve_sources(paths: DataFrame, journal: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Where each path's file is now: the destination of its last active move of the primary set, else the path.

    journal has idx, its order. With ``present`` (path: the files that exist) a path that exists stays as it is, and only
    destinations that exist count.
    """
    moved = journal.where(ACTIVE).where("source_set = 'primary'")
    if present is not None:
        here = present.select("path").distinct()
        moved = moved.join(here.withColumnRenamed("path", "destination"), "destination", "left_semi").join(here.withColumnRenamed("path", "source"), "source", "left_anti")
    last = moved.groupBy(F.col("source").alias("path")).agg(F.max_by("destination", "idx").alias("moved_to"))
    return paths.join(last, "path", "left").withColumn("resolved", F.coalesce("moved_to", "path"))


def safe_components(path: Column) -> Column:
    """A relative path without empty, '.' and '..' parts."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", "..")), "/")


#: A path's name up to its extension, and the extension; a dot that begins a name begins no extension.
NAME = r"(?s)^(.*?[^/])(\.[^./]*)?\z"


def plan_targets(files: DataFrame, root: str, order: Column) -> DataFrame:
    """target for each file under root: the same relative path, numbered _1, _2 ... before the extension where taken.

    Files take their targets in ``order``, and a number that an earlier file has, by number or by name, is passed over, so no
    two targets are equal. Only files whose names agree up to such numbers can meet; these are sorted together and stream
    through one task, which holds the names they have taken.
    """
    spark_fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    columns = files.columns
    wanted = F.concat(F.lit(root.rstrip("/") + "/"), safe_components(F.col("rel_path")))
    parts = files.withColumn("__wanted", wanted).withColumns({"__base": F.regexp_extract("__wanted", NAME, 1), "__dot": F.regexp_extract("__wanted", NAME, 2)})
    family = F.concat(F.regexp_replace("__base", r"(_[0-9]+)+\z", ""), F.lit("/"), "__dot")
    rows = parts.withColumns({"__family": family, "__order": order}).repartition("__family").sortWithinPartitions("__family", "__order")

    def take(batches):
        last, taken, tried = None, set(), {}
        for batch in batches:
            targets = []
            for family, whole, base, dot in zip(*[batch.column(c).to_pylist() for c in ("__family", "__wanted", "__base", "__dot")]):
                if family != last:
                    last, taken, tried = family, set(), {}
                target, n = whole, tried.get(whole, 0)
                while target in taken:
                    n += 1
                    target = f"{base}_{n}{dot if dot != '.' else ''}"
                tried[whole] = n
                taken.add(target)
                targets.append(target)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(targets, pa.string())], [*columns, "target"])

    return rows.mapInArrow(take, f"{spark_fields}, target string")


def rewrite_destinations(journal: DataFrame, old: str, new: str) -> DataFrame:
    """Destinations under the folder ``old`` as ones under ``new``; others, also of folders whose name only begins so, stay."""
    old, new = old.rstrip("/"), new.rstrip("/")
    inside = (F.col("destination") == old) | F.startswith("destination", F.lit(old + "/"))
    return journal.withColumn("destination", F.when(inside, F.concat(F.lit(new), F.substring("destination", F.lit(len(old) + 1), F.length("destination")))).otherwise(F.col("destination")))


def restore_plan(journal: DataFrame, asset_ids: list[str] | None = None) -> DataFrame:
    """Active moves to undo, by asset; all, or those of the assets named."""
    active = journal.where(ACTIVE)
    return active if asset_ids is None else active.where(F.col("asset_id").isin(asset_ids))
