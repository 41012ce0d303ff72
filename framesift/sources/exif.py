"""A reader of EXIF tags in JPEG and TIFF data, for the few that frames carry."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta
from typing import NamedTuple


class Exif(NamedTuple):
    iso: int | None = None
    aperture: float | None = None
    shutter_s: float | None = None
    focal_mm: float | None = None
    focal35_mm: int | None = None
    captured_at_ms: int | None = None


#: Tag numbers.
EXIF_IFD, DATE_TIME, EXPOSURE, FNUMBER, ISO, ORIGINAL, DIGITIZED = 0x8769, 0x0132, 0x829A, 0x829D, 0x8827, 0x9003, 0x9004
OFFSET, OFFSET_ORIGINAL, OFFSET_DIGITIZED, FOCAL, FOCAL35 = 0x9010, 0x9011, 0x9012, 0x920A, 0xA405
SUBSEC, SUBSEC_ORIGINAL, SUBSEC_DIGITIZED = 0x9290, 0x9291, 0x9292
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def tiff_block(data: bytes) -> bytes | None:
    """The TIFF structure: all of a TIFF file, or what the Exif segment of a JPEG holds."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + size
    return None


def directory(block: bytes, at: int, order: str) -> dict[int, object]:
    """The values of one image file directory; entries that point outside the data are left out."""
    found: dict[int, object] = {}
    for i in range(struct.unpack_from(order + "H", block, at)[0]):
        tag, kind, count = struct.unpack_from(order + "HHI", block, at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * count
        where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", block, at + 10 + 12 * i)[0]
        if not size or where + size > len(block):
            continue
        raw = block[where : where + size]
        if kind == 2:
            found[tag] = raw.split(b"\0")[0].decode("latin-1").strip()
        elif kind in (3, 4, 9):
            found[tag] = struct.unpack(order + {3: "H", 4: "I", 9: "i"}[kind] * count, raw)[0]
        elif kind in (5, 10):
            top, bottom = struct.unpack(order + ("II" if kind == 5 else "ii"), raw[:8])
            found[tag] = top / bottom if bottom else None
    return found


def timestamp(text: str | None, subsec: str | None, offset: str | None) -> int | None:
    """``Y:M:D h:m:s``, digits after the second, and ``+hh:mm``, as epoch ms; a fraction or offset that can't be read is ignored."""
    try:
        at = datetime.strptime(text or "", "%Y:%m:%d %H:%M:%S").replace(tzinfo=UTC)
    except ValueError:
        return None
    ms = int((subsec + "000")[:3]) if subsec and subsec.isascii() and subsec.isdigit() else 0
    if offset and len(offset) == 6 and offset[0] in "+-" and offset[3] == ":" and offset[1:3].isdigit() and offset[4:].isdigit():
        at -= (1 if offset[0] == "+" else -1) * timedelta(hours=int(offset[1:3]), minutes=int(offset[4:]))
    return int(at.timestamp()) * 1000 + ms


def read_exif(data: bytes) -> Exif:
    """What could be read; nothing at all for data without EXIF or with a broken one."""
    try:
        block = tiff_block(data)
        if block is None:
            return Exif()
        order = "<" if block[:2] == b"II" else ">"
        main = directory(block, struct.unpack_from(order + "I", block, 4)[0], order)
        sub = directory(block, main[EXIF_IFD], order) if isinstance(main.get(EXIF_IFD), int) else {}
    except (struct.error, IndexError):
        return Exif()
    number = lambda tag, kind: kind(v) if isinstance(v := sub.get(tag), (int, float)) else None
    dates = ((sub.get(ORIGINAL), SUBSEC_ORIGINAL, OFFSET_ORIGINAL), (sub.get(DIGITIZED), SUBSEC_DIGITIZED, OFFSET_DIGITIZED), (main.get(DATE_TIME), SUBSEC, OFFSET))
    times = (timestamp(text, sub.get(s), sub.get(o)) for text, s, o in dates if isinstance(text, str))
    return Exif(number(ISO, int), number(FNUMBER, float), number(EXPOSURE, float), number(FOCAL, float), number(FOCAL35, int), next((t for t in times if t is not None), None))
