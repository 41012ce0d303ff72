"""Tables written to the cluster's shared folder, to cut lineage and to run costly stages once.

A plan that is read by several jobs, or grown by a loop, is written here as Parquet and read again. The folder
is the one that ``spark.checkpoint.dir`` names, which every executor and the driver share; a lost executor only
repeats its own tasks. Files stay until the cluster cleans that folder, since the frames returned are lazy.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a folder of our own, but only if driver and executors are one
    machine: on a cluster executors would write where nobody else can read, so that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.framesift.staging", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        root = "file://" + tempfile.mkdtemp(prefix="framesift-")
        spark.conf.set("spark.framesift.staging", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path for files of this name in the shared folder."""
    return f"{shared_root(spark)}/framesift-{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
