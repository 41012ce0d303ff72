"""Files beside a run: thumbnails, previews, review exports, model packs, locale texts."""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.functions import kernels
from framesift.sources.images import to_rgb

#: The edges previews are made for.
LEAST_PREVIEW, MOST_PREVIEW = 1024, 8192


def png(rgb: np.ndarray) -> bytes:
    """A PNG of an RGB raster."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, w * 3)], axis=1)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 6)) + part(b"IEND", b"")


def publish(uri: str, data: bytes) -> None:
    """Written beside and renamed, so that a reader never sees half a file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(f"{path}.tmp", compression=None) as out:
        out.write(data)
    system.move(f"{path}.tmp", path)


def write_reduced(images: DataFrame, folder: str, edge: int, suffix: str = "") -> DataFrame:
    """A reduced PNG of each image (id and Spark's raster columns) at ``folder``/id.png, written by the executors.

    Gives id and file; images that can't be decoded have none.
    """

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                [row] = batch.slice(i, 1).to_pylist()  # one raster at a time
                if row["height"] < 1 or not row["data"]:
                    continue
                rgb = kernels.resize_long_edge(to_rgb(row["data"], row["height"], row["width"], row["nChannels"]), edge, "lanczos3")
                uri = f"{folder}/{row['id']}{suffix}.png"
                publish(uri, png(rgb))
                yield pa.RecordBatch.from_arrays([pa.array([row["id"]]), pa.array([uri])], ["id", "file"])

    return images.select("id", "height", "width", "nChannels", "data").mapInArrow(run, "id string, file string")


def write_thumbnails(images: DataFrame, folder: str, edge: int = 320) -> DataFrame:
    return write_reduced(images, f"{folder}/thumbs", edge)


def write_previews(images: DataFrame, folder: str, edge: int) -> DataFrame:
    """Previews of one edge, held to what previews are made for, which is part of the name."""
    edge = min(max(edge, LEAST_PREVIEW), MOST_PREVIEW)
    return write_reduced(images, f"{folder}/previews", edge, f"_{edge}")


def review_json(decisions: DataFrame, moved: DataFrame, source: str) -> str:
    """Decisions and what has been moved, as one document."""
    rows = decisions.select(F.to_json(F.struct("asset_id", "decision", "note", "updated_at")).alias("j")).orderBy("j").toLocalIterator()
    ids = [r[0] for r in moved.select("asset_id").distinct().orderBy("asset_id").toLocalIterator()]
    return json.dumps({"version": 1, "source": source, "move_status": {"asset_ids": ids}, "decisions": [json.loads(r[0]) for r in rows]}, ensure_ascii=False)


def load_model(path: str, sha256: str) -> bytes:
    """A model file whose digest is as expected."""
    with open(path, "rb") as file:
        data = file.read()
    if hashlib.sha256(data).hexdigest() != sha256.lower():
        raise ValueError(f"{path} is not the model that was expected")
    return data


def load_texts(folder: str, language: str, known: tuple[str, ...] = ("en",)) -> dict[str, str]:
    """The texts of a language; English for one that isn't known or has no file."""
    for name in (language if language in known else "en", "en"):
        path = f"{folder}/{name}.json"
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as file:
                return json.load(file)
    return {}


def remove_empty_folders(folder: str, root: str) -> None:
    """Remove a folder and those above it, as far as root, while they are empty."""
    folder, root = os.path.abspath(folder), os.path.abspath(root)
    while folder.startswith(root + os.sep) and os.path.isdir(folder) and not os.listdir(folder):
        os.rmdir(folder)
        folder = os.path.dirname(folder)
