"""Image files to scored frames: decoded by Spark's image source, measured in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import kernels
from framesift.sources.exif import read_exif

METRIC_FIELDS = ", ".join(f"{n} {'string' if n == 'dhash' else 'double'}" for n in kernels.Metrics().as_dict())
SCORED = (
    f"path string, width int, height int, feature_backend string, error string, {METRIC_FIELDS}, global_luma binary, subject_luma binary, subject_edges binary, "
    "subject_mask binary, subject_confidence double, subject_area_fraction double, feature_ms double"
)


def load_images(spark: SparkSession, root: str) -> DataFrame:
    """path and the decoded raster of every image under root; what can't be decoded has height -1."""
    found = spark.read.format("image").option("recursiveFileLookup", "true").load(root)
    return found.select(F.regexp_replace("image.origin", r"^file:(//)?", "").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Spark's rasters have blue first, and may have one channel or a fourth one."""
    raster = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raster, 3, axis=2) if channels == 1 else np.ascontiguousarray(raster[..., 2::-1])


Detector = Callable[[np.ndarray, kernels.Metrics], "kernels.Detection | None"]


def detected(rgb: np.ndarray, metrics: kernels.Metrics, detector: Detector | None) -> kernels.Metrics:
    """The metrics with what a detector found in the picture. Without a detector the measured box is its own finding; a
    detector that fails or finds nothing counts as none. Focus is measured again in a box that agrees with the measured one."""
    found = None
    if detector is not None:
        try:
            found = detector(rgb, metrics)
        except Exception:
            found = None
    if found is None:
        return kernels.merge_detection(metrics, kernels.heuristic_detection(metrics))
    merged = kernels.merge_detection(metrics, found)
    return kernels.refocus(rgb, merged) if merged is not metrics and kernels.box_iou(metrics.box, merged.box) >= 0.25 else merged


def score_images(images: DataFrame, edge: int, detection: str = "off", detector: Detector | None = None) -> DataFrame:
    """Metrics and descriptors of each image, reduced to a longer edge of at most ``edge``. An image that can't be read is a
    row with an error, its own where ``images`` has a column for it. Descriptors come from the measured box, whatever a
    detector says later. ``detection`` is off, heuristic (auto is the same) or ml, which asks ``detector``."""
    if detection not in ("off", "auto", "heuristic", "ml"):
        raise ValueError(f"no detector {detection!r}")

    def run(batches):
        names = [f.split()[0] for f in SCORED.split(", ")]
        for batch in batches:
            for i in range(len(batch)):
                [row] = batch.slice(i, 1).to_pylist()  # one raster at a time
                out = dict.fromkeys(names) | {"path": row["path"]}
                began = time.perf_counter()
                if row["height"] < 1 or not row["data"]:
                    out |= kernels.Metrics().as_dict() | {"error": row.get("error") or "image can't be decoded", "feature_backend": "none", "subject_confidence": 0.0, "subject_area_fraction": 0.0}
                else:
                    rgb = kernels.resize_long_edge(to_rgb(row["data"], row["height"], row["width"], row["nChannels"]), edge, "lanczos3")
                    metrics, backend = kernels.score_image(rgb)
                    described = kernels.describe(rgb, metrics)
                    if detection != "off":
                        metrics = detected(rgb, metrics, detector if detection == "ml" else None)
                    out |= metrics.as_dict() | {"width": row["width"], "height": row["height"], "feature_backend": backend}
                    out |= {n: getattr(described, n).tobytes() for n in ("global_luma", "subject_luma", "subject_edges", "subject_mask")}
                    out |= {"subject_confidence": described.confidence, "subject_area_fraction": described.area_fraction}
                out["feature_ms"] = (time.perf_counter() - began) * 1000
                yield pa.RecordBatch.from_pylist([out], schema=ARROW)

    return images.mapInArrow(run, SCORED)


KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
ARROW = pa.schema([(n, KINDS[k]) for n, k in (f.split() for f in SCORED.split(", "))])


def refine_images(images: DataFrame, candidates: DataFrame, edge: int, detection: str = "off", detector: Detector | None = None) -> DataFrame:
    """Metrics at a higher resolution for the candidates (id, path) only: the others are left out before any is measured."""
    chosen = images.join(candidates.select("path"), "path", "left_semi")
    scored = score_images(chosen.select("path", "height", "width", "nChannels", "data"), edge, detection, detector).where("error IS NULL")
    return scored.join(candidates.select("id", "path"), "path").withColumn("refine_size", F.lit(edge))


EXIF_FIELDS = "path string, iso int, aperture double, shutter_s double, focal_mm double, focal35_mm int, captured_at_ms bigint"


def load_exif(spark: SparkSession, root: str) -> DataFrame:
    """path and the EXIF fields of every file under root, null where there are none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:(//)?", "").alias("path"), "content")

    def run(batches):
        for batch in batches:
            rows = [read_exif(c) for c in batch.column("content").to_pylist()]
            kinds = (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("path"), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds)]], [f.split()[0] for f in EXIF_FIELDS.split(", ")])

    return files.mapInArrow(run, EXIF_FIELDS)


def describe_row(row: tuple) -> kernels.Descriptor:
    """A descriptor from its binary columns."""
    parts = [np.frombuffer(b or b"", np.uint8) for b in row[:4]]
    return kernels.Descriptor(*parts, row[4] or 0.0, row[5] or 0.0)
