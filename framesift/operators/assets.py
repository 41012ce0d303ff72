"""Files to logical assets: everything with the same folder and stem is one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions import columns as C

DISCOVERY_ORDER = ("directory", "prefix", "seq_key", "time_key", "stem")


def classify_files(files: DataFrame, root: str = "") -> DataFrame:
    """Files (path, ...) with rel_path, directory, stem, extension and kind; hidden ``._`` names and unknown kinds go."""
    rel = C.relative_path(F.col("path"), root) if root else F.replace(F.col("path"), F.lit("\\"), F.lit("/"))
    named = files.withColumn("rel_path", rel).withColumn("name", C.file_name(F.col("rel_path")))
    parts = named.withColumns({"directory": C.directory(F.col("rel_path")), "extension": C.extension(F.col("name")), "stem": C.stem(F.col("name"))})
    kinds = parts.withColumn("kind", C.file_kind(F.col("extension")))
    return kinds.where(~F.col("name").startswith("._") & F.col("kind").isNotNull()).drop("name")


def group_assets(files: DataFrame) -> DataFrame:
    """One row for each (directory, stem) that has more than sidecars: the files in order of preference, sidecars, representative,
    prefix, seq, id and the earliest known times. Names are compared as they are, case included."""
    rank = (
        F.when(F.col("extension").isin("jpg", "jpeg"), 0).when(F.col("extension").isin("png", "webp"), 1).when(F.col("extension").isin("tif", "tiff"), 2).otherwise(3)
    )
    entry = F.struct((F.col("kind") == "raw").cast("int").alias("kind_rank"), rank.alias("ext_rank"), "rel_path", "kind", "extension", "created_ms", "modified_ms")
    sidecar = F.when(F.col("kind") == "sidecar", F.col("rel_path"))
    grouped = files.groupBy("directory", "stem").agg(
        F.sort_array(F.collect_list(F.when(F.col("kind") != "sidecar", entry))).alias("entries"), F.sort_array(F.collect_list(sidecar)).alias("sidecars")
    )
    first = F.element_at("entries", 1)
    return grouped.where(F.size("entries") > 0).select(
        C.stable_id(first["rel_path"]).alias("id"),
        "directory",
        "stem",
        C.stem_prefix(F.col("stem")).alias("prefix"),
        C.stem_sequence(F.col("stem")).alias("seq"),
        first["rel_path"].alias("representative"),
        F.transform("entries", lambda e: e["rel_path"]).alias("files"),
        "sidecars",
        first["created_ms"].alias("created_ms"),
        first["modified_ms"].alias("modified_ms"),
    )


def with_order_keys(frames: DataFrame, time: str = "time_ms") -> DataFrame:
    """seq_key and time_key: a missing number sorts first, a missing time last."""
    return frames.withColumns({"seq_key": F.coalesce("seq", F.lit(-1)), "time_key": F.coalesce(time, F.lit((1 << 63) - 1))})
