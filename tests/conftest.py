import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession

from framesift.session import let_workers_import


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    let_workers_import(session)
    yield session
    session.stop()


def png(rgb: np.ndarray) -> bytes:
    """An uncompressed-filter PNG of an RGB raster."""
    h, w = rgb.shape[:2]
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pose(x: int, vertical: bool = False) -> np.ndarray:
    """A dark bar on a light ground, lying or standing."""
    rgb = np.zeros((240, 320, 3), np.uint8)
    rgb[:] = (165, 190, 210)
    h, w = (44, 9) if vertical else (8, 45)
    rgb[100 : 100 + h, x : x + w] = (20, 24, 29)
    return rgb
