import hashlib

import zstandard

from framesift.llm import warc
from framesift.plans.staging import shared_path

PAGES = "page_id bigint, url string, html string, digest string, first string"


def page_rows():
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"<p>{'y' * i}</p>" + "é" * 60, "d", "f") for i in range(60)]
    rows += [(100, None, None, "d", "f"), (101, "http://a b\n/x", "", "d", "f"), (102, "u", "short", "d", "f"), (103, "u", "short", "d", "f"), (None, "u", big, "d", "f"), rows[4], rows[3], rows[0]]
    return rows


def plain(rows):
    firsts = {}
    for i, _, html, *_ in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            firsts[html] = min(firsts.get(html, i), i)
    out = []
    for i, _, html, *_ in rows:
        body = (html or "").encode()
        again = html in firsts and len(body) >= 100 and i != firsts[html]
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", firsts[html] if again else None))
    return sorted(map(repr, out))


def test_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), PAGES).repartition(3)
    assert sorted(repr(tuple(r)) for r in warc.archive_pages(pages).collect()) == plain(page_rows())
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_small_bundles_and_single_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 1000)
    rows = page_rows()[:60]
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), shared_path(spark, "warc-test"))
    at = index.where("page_id = 7").first()
    fields, payload = warc.read_record(at.bundle, at.frame, at.offset)
    assert payload.decode() == rows[7][2] and fields["WARC-Target-URI"] == "http://h/7" and fields["WARC-Type"] == "response"


def test_bundles_are_plain_zstandard_too(tmp_path):
    writer = warc.BundleWriter(f"file://{tmp_path}/b.warc.zst")
    records = [warc.record(i, "u", b"z" * 5000, "0" * 64, None, False) for i in range(500)]
    places = [writer.add(r) for r in records]
    writer.close()
    data = (tmp_path / "b.warc.zst").read_bytes()
    assert len(writer.frames) > 1 and places[-1][0] == len(writer.frames) - 1
    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as reader:
        assert reader.read() == b"".join(records)
    assert b"".join(warc.read_frames(f"file://{tmp_path}/b.warc.zst")) == b"".join(records)


def test_bundles_roll_over_and_are_read_back_a_task_each(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2_000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 3_000)
    noise = ["".join(hashlib.sha512(f"{i} {k}".encode()).hexdigest() for k in range(4)) for i in range(120)]
    rows = [(i, "u", t, "d", "f") for i, t in enumerate(noise)] + [(500, "u", "".join(noise), "d", "f")]  # one record larger than a frame
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), shared_path(spark, "warc-test"))
    back = warc.read_archives(index)
    bundles = index.select("bundle").distinct().count()
    assert bundles > 4 and back.rdd.getNumPartitions() == bundles
    assert sorted(repr(tuple(r)) for r in back.collect()) == plain(rows)
