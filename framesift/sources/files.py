"""File listings: of a local or mounted folder with creation times, or of any store that Spark reads."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, size bigint, created_ms bigint, modified_ms bigint"


def walk(root: str) -> Iterator[tuple[str, int, int | None, int | None]]:
    """Regular files under root, links not followed, hidden ``._`` names left out; times before 1970 are null."""
    ms = lambda s: int(s * 1000) if s is not None and s >= 0 else None
    for folder, _, names in os.walk(root, followlinks=False):
        for name in names:
            path = os.path.join(folder, name)
            if name.startswith("._") or os.path.islink(path) or not os.path.isfile(path):
                continue
            stat = os.stat(path)
            yield path.replace("\\", "/"), stat.st_size, ms(getattr(stat, "st_birthtime", None)), ms(stat.st_mtime)


def list_local(spark: SparkSession, root: str) -> DataFrame:
    """A folder that the driver sees, with creation times where the system has them."""
    return spark.createDataFrame(list(walk(root)), SCHEMA)


def list_store(spark: SparkSession, root: str) -> DataFrame:
    """A folder of any store, listed by Spark; there are no creation times. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = F.regexp_replace("path", r"^file:(//)?", "")
    return found.select(plain.alias("path"), F.col("length").alias("size"), F.lit(None).cast("bigint").alias("created_ms"), F.unix_millis("modificationTime").alias("modified_ms"))
