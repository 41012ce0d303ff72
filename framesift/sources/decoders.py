"""Decoding with a fallback: Spark's image source first, then external programs, in order, for what it can't read and for RAW.

A decoder is a function of a file's content that gives an RGB raster or raises. External ones are handed in, so a cluster
uses what its executors have; ``imagemagick`` makes one from a program's path.
"""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.functions import columns as C
from framesift.sources.images import load_images

Decoder = Callable[[bytes], np.ndarray]
RASTER = "path string, height int, width int, nChannels int, data binary, decoder string, error string"
#: The texts of errors that end up in exports.
NO_DECODER = "no external decoder found for {path}; install ImageMagick or use a camera JPEG pair"
ALL_FAILED = "external decoder failed for {path}: {failures}"
BOTH_FAILED = "native decode failed ({native}); external decoder fallback also failed for {path}"
KINDS = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())


def parse_ppm(data: bytes) -> np.ndarray:
    """The raster of a binary PPM or PGM with 8 bits a sample."""
    head = re.match(rb"(P[56])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s", data)
    if not head or int(head[4]) != 255:
        raise ValueError("not an 8-bit PPM")
    width, height, channels = int(head[2]), int(head[3]), 3 if head[1] == b"P6" else 1
    raster = np.frombuffer(data, np.uint8, width * height * channels, head.end()).reshape(height, width, channels)
    return np.repeat(raster, 3, axis=2) if channels == 1 else raster


def imagemagick(program: str, edge: int | None = None, seconds: int = 120) -> Decoder:
    """An external program that reads a picture from its input and writes a PPM, reduced to a longer edge of ``edge``."""

    def decode(content: bytes) -> np.ndarray:
        size = ["-resize", f"{edge}x{edge}>"] if edge else []
        done = subprocess.run([program, "-", "-auto-orient", *size, "-depth", "8", "ppm:-"], input=content, capture_output=True, timeout=seconds)
        if done.returncode:
            raise ValueError(done.stderr.decode("utf-8", "replace").strip() or f"exit code {done.returncode}")
        return parse_ppm(done.stdout)

    return decode


def external_decoders(which: Callable[[str], str | None] = shutil.which, edge: int | None = None) -> list[tuple[str, Decoder]]:
    """The external decoders of this machine: one program of two names, the newer name first."""
    program = which("magick") or which("convert")
    return [(f"ImageMagick ({program})", imagemagick(program, edge))] if program else []


def decode_external(content: bytes, path: str, external: list[tuple[str, Decoder]]) -> tuple[np.ndarray, str]:
    """The raster of the first decoder that succeeds and its name; else an error that has all of theirs."""
    failures = []
    for name, decode in external:
        try:
            return decode(content), name
        except Exception as e:
            failures.append(f"{name}: {e}")
    if not failures:
        raise ValueError(NO_DECODER.format(path=path))
    raise ValueError(ALL_FAILED.format(path=path, failures="; ".join(failures)))


def load_with_fallback(spark: SparkSession, root: str, external: list[tuple[str, Decoder]], candidates: DataFrame | None = None) -> DataFrame:
    """The rasters of all pictures under root as ``load_images`` has them, with decoder, and error where none could read a file.

    RAW files go to the external decoders alone; other files only if Spark can't read them, and their error then says so.
    Contents are read again for those files only. With ``candidates`` (path) others are left out.
    """
    kind = C.file_kind(C.extension(C.file_name(F.col("path"))))
    native = load_images(spark, root).withColumn("__raw", kind == "raw").where(kind.isin("raw", "compressed"))
    if candidates is not None:
        native = native.join(candidates.select("path"), "path", "left_semi")
    read = native.where("NOT __raw AND height > 0").drop("__raw").withColumns({"decoder": F.lit("native"), "error": F.lit(None).cast("string")})
    left = native.where("__raw OR height < 1").select("path", "__raw")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", r"^file:(//)?", "").alias("path"), "content")

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):  # one content and one raster at a time
                path, raw, content = (batch.column(c)[i].as_py() for c in ("path", "__raw", "content"))
                try:
                    rgb, name = decode_external(content, path, external)
                    row = (path, rgb.shape[0], rgb.shape[1], 3, np.ascontiguousarray(rgb[..., ::-1]).tobytes(), name, None)
                except ValueError as e:
                    said = str(e) if raw else f"{BOTH_FAILED.format(native='not readable as a picture', path=path)}: {e}"
                    row = (path, -1, -1, -1, None, "none", said)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, KINDS)], [f.split()[0] for f in RASTER.split(", ")])

    return read.unionByName(left.join(contents, "path").select("path", "__raw", "content").mapInArrow(run, RASTER))


def capabilities(which: Callable[[str], str | None] = shutil.which) -> dict:
    """What this machine decodes, detects and measures with, for manifests and diagnostics."""
    program = which("magick") or which("convert")
    return {
        "decoders": {
            "native_compressed": True,
            "scaled_jpeg": False,
            "imagemagick": program,
            "raw_strategy": "ImageMagick RAW/HEIC fallback" if program else "native compressed formats only; RAW requires ImageMagick or sips",
        },
        "detector": {"available": ["off", "heuristic"], "selected": "heuristic", "notes": ["a learned detector has to be handed in; without one the measured box is the finding"]},
        "acceleration": {"available": ["cpu"], "focus_backend": "cpu_portable", "parallelism_backend": "spark"},
    }
