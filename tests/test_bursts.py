"""Bursts and stacks against plain greedy loops over random rows."""

import random

import numpy as np
from pyspark.sql import functions as F

from framesift.operators import bursts, similarity
from framesift.options import ScanOptions
from framesift.plans.fold import number_rows
from framesift.streaming.bursts import stream_bursts, stream_late_bursts

FRAME = "directory string, prefix string, seq bigint, time_ms bigint, stem string"


def random_frames(seed: int, n: int = 400) -> list[tuple]:
    r = random.Random(seed)
    return [
        (r.choice("ab"), r.choice(["", "IMG_"]), r.choice([None, *range(60)]), r.choice([None, *range(0, 60_000, 400)]), f"s{i:04d}") for i in range(n)
    ]


def greedy(rows: list[tuple], o: ScanOptions) -> list[list[str]]:
    order = sorted(rows, key=lambda r: (r[0], r[1], -1 if r[2] is None else r[2], (1 << 63) - 1 if r[3] is None else r[3], r[4]))
    out, start, prev = [], None, None
    for row in order:
        split = prev is None or row[:2] != prev[:2]
        if not split and row[3] is not None and prev[3] is not None:
            split = abs(row[3] - prev[3]) > o.max_time_gap_ms or (start is not None and abs(row[3] - start) > o.max_cluster_span_ms)
        if not split and row[2] is not None and prev[2] is not None:
            split = row[2] - prev[2] > o.max_seq_gap
        if split:
            out.append([])
            start = row[3]
        out[-1].append(row[4])
        prev = row
    return out


def test_bursts_match_greedy(spark):
    for seed in range(3):
        rows, o = random_frames(seed), ScanOptions(max_time_gap_ms=8_000, max_cluster_span_ms=15_000, max_seq_gap=2)
        got = bursts.bursts(spark.createDataFrame(rows, FRAME).repartition(5), o).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.burst_id, r.pos)):
            found.setdefault(r.burst_id, []).append(r.stem)
        assert [found[i] for i in sorted(found)] == greedy(rows, o)
        assert sorted(found) == list(range(1, len(found) + 1))


def test_thresholds_are_strict(spark):
    o = ScanOptions()
    rows = [("d", "", i, t, f"{i:02d}") for i, t in enumerate([0, 1250, 1800, 1801, 3051 + 1])]
    got = sorted(bursts.split_bursts(spark.createDataFrame(rows, FRAME), o).collect(), key=lambda r: r.seq)
    assert [r.burst_start for r in got] == [True, False, False, True, True]


def test_complete_link_prevents_chaining_and_matches_greedy(spark):
    r = np.random.default_rng(3)
    rows = [(int(i % 3), i, r.integers(0, 256, 12).tolist() if i % 4 else [10 * (i % 7)] * 12) for i in range(150)]
    df = spark.createDataFrame(rows, "burst_id bigint, pos bigint, u8 array<int>")

    def compare(row, many):
        return similarity.array_correlation(np.asarray(row[0]), np.stack([np.asarray(m[0]) for m in many])), np.ones(len(many))

    got = similarity.stack_frames(df.repartition(4), ["burst_id"], [F.col("pos")], ["u8"], compare, lambda a, b: True, 0.5).collect()
    starts = {r.pos for r in got if r.stack_start}
    want = set()
    for b in range(3):
        current = []
        for _, pos, u8 in sorted(x for x in rows if x[0] == b):
            d = similarity.array_correlation(np.asarray(u8), np.stack([np.asarray(c) for c in current])) if current else np.array([9.0])
            if not (d <= 0.5).all():
                current = []
                want.add(pos)
            current.append(u8)
    assert starts == want


def test_numbers_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = number_rows(df, [F.col("v")], "n").collect()
    assert all(r.n == r.v + 1 for r in got) and len(got) == 1000
    assert number_rows(df.limit(0), [F.col("v")], "n").count() == 0


def test_stream_gives_the_same_bursts(spark, tmp_path):
    o = ScanOptions(max_time_gap_ms=8_000, max_cluster_span_ms=15_000, max_seq_gap=2)
    rows = [("d", "p", None, t, f"{t:07d}") for t in sorted(random.Random(2).sample(range(0, 600_000, 500), 120))]
    for i in range(0, 120, 40):
        spark.createDataFrame(rows[i : i + 40], FRAME).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    source = spark.readStream.schema(FRAME).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = stream_bursts(source, o).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = {}
    for r in spark.sql("SELECT * FROM bursts ORDER BY time_ms").collect():
        found.setdefault(r.burst_no, []).append(r.stem)
    assert [found[i] for i in sorted(found)] == greedy(rows, o)


def test_late_frames_get_the_bursts_of_their_place(spark, tmp_path):
    """Frames that come up to 20 s late, in shuffled batches, then one far later, which moves the watermark past them all."""
    o = ScanOptions(max_time_gap_ms=8_000, max_cluster_span_ms=15_000, max_seq_gap=2)
    r = random.Random(3)
    times = sorted(r.sample(range(1_000_000, 1_600_000, 500), 120))
    arrival = sorted(times, key=lambda t: t + r.randrange(20_000))
    batches = [arrival[i : i + 40] for i in range(0, 120, 40)] + [[9_000_000], [9_100_000]]
    for i, batch in enumerate(batches):
        spark.createDataFrame([("d", "p", None, t, f"{t:07d}") for t in batch], FRAME).coalesce(1).write.parquet(str(tmp_path / f"in/{i:03d}"))
    source = spark.readStream.schema(FRAME).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = stream_late_bursts(source, o, 25_000).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = {}
    for row in spark.sql("SELECT * FROM late WHERE time_ms < 2000000 ORDER BY time_ms").collect():
        found.setdefault(row.burst_ms, []).append(row.stem)
        assert row.burst_start == (row.burst_ms == row.time_ms)
    assert [found[i] for i in sorted(found)] == greedy([("d", "p", None, t, f"{t:07d}") for t in times], o)
