"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records, closed by a skippable frame with the
seek table: for each data frame its compressed and decompressed size. Any frame can be read alone, and ordinary
Zstandard readers see one stream. An index row names for each record the bundle, its frame, and the offset within the
frame's decompressed bytes, so one record costs the seek table, one frame and a slice.

A task writes its bundles under names of its own and the index holds the names that were finished: a task that is run
again after a lost executor writes new bundles, and what it left behind is named by no index row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.held import release
from framesift.plans.staging import shared_path, stage

#: Fixed values of the seekable format: the skippable frame that holds the table, and the number that ends a file.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 20, 128 << 20, 3
SMALLEST_REVISIT = 100


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing frame for data frames of these (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each data frame."""
    size = file.size()
    count, flags, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table without checksums at the end of the bundle")
    raw, out, offset = file.read_at(8 * count, size - 9 - 8 * count), [], 0
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((offset, packed, plain))
        offset += packed
    return out


def header(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def record_id(page_id: int | None) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def page_of(uri: str) -> int | None:
    last = uri.strip("<>").rpartition(":")[2]
    return None if last == "none" else int(last)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the digest and length of its payload, not the payload; a url's control characters
    and spaces are percent-encoded, and a null url is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{record_id(page_id)}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields["WARC-Payload-Digest"] = f"sha256:{digest}"
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<{record_id(refers_to)}>"
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return header(fields) + block + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at an offset: WARC fields, HTTP head, payload, and where the next record begins."""
    head_end = data.index(b"\r\n\r\n", at)
    lines = data[at:head_end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    start = head_end + 4
    end = start + int(fields["Content-Length"])
    http, _, payload = data[start:end].partition(b"\r\n\r\n")
    return fields, http, payload, end + 4


class BundleWriter:
    """Writes one bundle; ``add`` returns a record's frame and its offset in the frame."""

    def __init__(self, path: str, frame_bytes: int | None = None):
        self.frame_bytes = frame_bytes or FRAME_BYTES
        system, self.path = fs.FileSystem.from_uri(path)
        self.out = system.open_output_stream(self.path, compression=None)  # else the name would compress it again
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.open, self.size = [], 0
        self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.size and self.size + len(data) > self.frame_bytes:
            self.close_frame()
        place = len(self.frames), self.size
        self.open.append(data)
        self.size += len(data)
        return place

    def close_frame(self) -> None:
        if self.size:
            packed = self.packer.compress(b"".join(self.open))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.open, self.size = [], 0

    def close(self) -> None:
        self.close_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()


def read_frames(path: str) -> Iterator[bytes]:
    """All frames of a bundle, one at a time."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        for offset, packed, plain in read_seek_table(file):
            yield zstandard.ZstdDecompressor().decompress(file.read_at(packed, offset), max_output_size=plain)


def read_record(path: str, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record's WARC fields and payload, by its index row."""
    system, inner = fs.FileSystem.from_uri(path)
    with system.open_input_file(inner) as file:
        at, packed, plain = read_seek_table(file)[frame]
        fields, _, payload, _ = parse(zstandard.ZstdDecompressor().decompress(file.read_at(packed, at), max_output_size=plain), offset)
        return fields, payload


INDEX = "page_id bigint, bundle string, frame int, offset bigint"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) into bundles under ``folder``; the index, written too.

    Null html is an empty payload. Among payloads of at least 100 bytes that are equal, the smallest page_id's is the
    response and the others revisit it (rows repeated with that page_id are all responses); smaller ones are always
    responses. A null page_id is after all others. Other columns are not kept.

    First pages are found from digests alone, with a minimum taken before the shuffle; the join that gives each page its
    first is one of narrow rows, which adaptive execution splits for a digest that many pages share. The html is moved
    once, dealt out by page.
    """
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    slim = stage(base.select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("bytes")), "digests")
    large = slim.where(F.col("bytes") >= SMALLEST_REVISIT)
    firsts = stage(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "firsts")
    later = large.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    sent = base.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("mark", F.xxhash64("page_id", "digest"))
    marked = later.select(F.xxhash64("page_id", "digest").alias("mark"), F.col("page_id").alias("later_id"), F.col("digest").alias("later_digest"), "first")
    same = (sent["mark"] == marked["mark"]) & sent["page_id"].eqNullSafe(marked["later_id"]) & (sent["digest"] == marked["later_digest"])
    rows = sent.join(marked.hint("merge"), same, "left").select("page_id", "url", "html", sent["digest"], "first", F.col("later_digest").isNotNull().alias("revisit"))

    def write(batches):
        release()
        writer, done = None, []

        def finished():
            writer.close()
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([writer_path] * len(done), pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["page_id", "bundle", "frame", "offset"])

        for batch in batches:
            for i, url, html, digest, first, revisit in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first", "revisit")]):
                if writer is None:
                    writer_path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
                    writer, done = BundleWriter(writer_path, FRAME_BYTES), []
                done.append((i, *writer.add(record(i, url, html.encode("utf-8", "surrogatepass"), digest, first, revisit))))
                if writer.written >= BUNDLE_BYTES:
                    yield finished()
                    writer = None
        if writer is not None:
            yield finished()

    return stage(rows.mapInArrow(write, INDEX), "warc-index")


PAGES_BACK = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, read frame by frame: page_id, payload_bytes, payload_digest,
    record_type and refers_to. A response's payload is measured and hashed; a revisit says both of the payload it had.

    Names are few bytes however much they stand for, so the tasks are counted: one a bundle."""
    bundles = stage(index.select("bundle").distinct(), "bundles")
    tasks = max(1, bundles.count())

    def run(batches):
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                for data in read_frames(path):
                    at, out = 0, []
                    while at < len(data):
                        fields, http, payload, at = parse(data, at)
                        page, kind = page_of(fields["WARC-Record-ID"]), fields["WARC-Type"]
                        if kind == "revisit":
                            size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                            out.append((page, size, fields["WARC-Payload-Digest"].removeprefix("sha256:"), kind, page_of(fields["WARC-Refers-To"])))
                        else:
                            out.append((page, len(payload), hashlib.sha256(payload).hexdigest(), kind, None))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.repartition(tasks, "bundle").mapInArrow(run, PAGES_BACK)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write the archives to the shared folder and read them back."""
    return read_archives(write_archives(pages, shared_path(pages.sparkSession, "warc")))
