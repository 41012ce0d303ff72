import random

from pyspark.sql import functions as F

from framesift import options
from framesift.functions import columns as C
from framesift.operators import assets, counterpart, moves, review
from framesift.sources.exif import read_exif, timestamp


def test_hash_distance(spark):
    rows = [("f" * 16, "0" * 16, 64), ("0f", "00", 4), ("", "00", 64), ("zz", "00", 64), ("12zz", "00", 64), ("8000000000000000", "0", 1), (None, "0", 64)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    assert all(r.d == r.want for r in df.withColumn("d", C.hash_distance(F.col("a"), F.col("b"))).collect())


def test_stems(spark):
    rows = [("DSC_0042", "DSC_", 42), ("image", "image", None), ("7", "", 7), ("a99999999999999999999", "a", None), ("x٣", "x", None), ("a1\n", "a1\n", None)]
    df = spark.createDataFrame(rows, "s string, prefix string, seq bigint")
    assert all(r.p == r.prefix and r.q == r.seq for r in df.select("*", C.stem_prefix(F.col("s")).alias("p"), C.stem_sequence(F.col("s")).alias("q")).collect())


def test_capture_times(spark):
    assert timestamp("2024:06:15 12:34:56", "125", "+08:00") == 1718426096125
    assert timestamp("nonsense", None, None) is None and timestamp("2024:06:15 12:34:56", "x", "later") == 1718454896000
    rows = [("2024:06:15 12:34:56", "125", "+08:00"), ("2024:06:15 12:34:56", "x", "later"), ("no", None, None), ("2024:06:15 12:34:56", None, None)]
    df = spark.createDataFrame(rows, "t string, s string, o string")
    got = [r.ms for r in df.select(C.exif_millis(F.col("t"), F.col("s"), F.col("o")).alias("ms")).collect()]
    assert got == [1718426096125, 1718454896000, None, 1718454896000]
    assert read_exif(b"junk").captured_at_ms is None and read_exif(b"II*\0\xff\xff\xff\xff").iso is None


def test_texts(spark):
    rows = [(0.0, ""), (0.004, "1/250s"), (0.75, "0.75s"), (1.0, "1s"), (1.5, "1.5s"), (2.25, "2.25s"), (10.0, "1s"), (30.0, "3s")]
    df = spark.createDataFrame(rows, "s double, want string")
    assert all(r.t == r.want for r in df.withColumn("t", C.shutter_text(F.col("s"))).collect())


def test_grouping_rules(spark):
    paths = ["/r/a/IMG_1.NEF", "/r/a/IMG_1.jpg", "/r/a/IMG_1.xmp", "/r/a/img_1.jpg", "/r/a/IMG_1.jpg.xmp", "/r/a/only.xmp", "/r/a/._IMG_2.jpg", "/r/a/.jpg", "/r/a/n.txt", "/r/IMG_3.png"]
    files = spark.createDataFrame([(p, 1, 2) for p in paths], "path string, created_ms bigint, modified_ms bigint")
    got = {(r.directory, r.stem): r for r in assets.group_assets(assets.classify_files(files, "/r")).collect()}
    assert set(got) == {("a", "IMG_1"), ("a", "img_1"), ("", "IMG_3")}
    one = got["a", "IMG_1"]
    assert one.files == ["a/IMG_1.jpg", "a/IMG_1.NEF"] and one.sidecars == ["a/IMG_1.xmp"] and one.representative == "a/IMG_1.jpg" and (one.prefix, one.seq) == ("IMG_", 1)


def test_counterparts(spark):
    primary = spark.createDataFrame(
        [("1", "A1", True, False, "reject"), ("2", "B1", True, False, "reject"), ("3", "b1", True, False, "keep"), ("4", "C1", False, True, "reject"), ("5", "D1", True, True, "reject"),
         ("6", "E1", True, False, "reject"), ("7", "F1", True, False, "reject"), ("8", "G1", True, False, "review")],
        "id string, stem string, has_raw boolean, has_compressed boolean, operation_action string",
    )
    card = spark.createDataFrame([("x", "a1", False, True), ("y", "B1", False, True), ("z", "c1", False, True), ("v", "e1", False, True), ("w", "E1", False, True), ("u", "f1", False, True)], "card_id string, stem string, has_raw boolean, has_compressed boolean")
    active = spark.createDataFrame([("7",)], "asset_id string")
    got = {r.id: (r.status, r.card_id) for r in counterpart.plan_counterparts(primary, card, active).collect()}
    assert got == {"1": ("matched", "x"), "2": ("conflicting", None), "4": ("unmatched", None), "5": ("skipped_paired", None), "6": ("ambiguous", None), "7": ("already_applied", None)}


def test_paths_and_targets(spark):
    df = spark.createDataFrame([("a/../b//c.jpg", 1), ("b/c.jpg", 2), ("./b/c.jpg", 3)], "rel_path string, n int")
    got = [r.target for r in moves.plan_targets(df, "/out", F.col("n")).orderBy("n").collect()]
    assert got == ["/out/a/b/c.jpg", "/out/b/c.jpg", "/out/b/c_1.jpg"]
    names = ["a.jpg", "a.jpg", "a_1.jpg", "a_1.jpg", "a.jpg", "A.jpg", ".x", ".x", "n", "n", "n_2", "n", "d.e/f", "d.e/f", "t.", "t."]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "rel_path string, n int").repartition(5)
    got = [r.target.removeprefix("/o/") for r in moves.plan_targets(df, "/o", F.col("n")).orderBy("n").collect()]
    assert got == ["a.jpg", "a_1.jpg", "a_1_1.jpg", "a_1_2.jpg", "a_2.jpg", "A.jpg", ".x", ".x_1", "n", "n_1", "n_2", "n_3", "d.e/f", "d.e/f_1", "t.", "t_1"]


def test_sources_that_have_moved(spark):
    journal = spark.createDataFrame(
        [(1, "primary", "/c/a", "/o/a", None), (2, "primary", "/c/a", "/p/a", None), (3, "counterpart", "/c/b", "/o/b", None), (4, "primary", "/c/d", "/o/d", None), (5, "primary", "/c/e", "/o/e", "then")],
        "idx int, source_set string, source string, destination string, restored_at string",
    )
    paths = spark.createDataFrame([(f"/c/{x}",) for x in "abde"], "path string")
    at = lambda df: {r.path: r.resolved for r in df.collect()}
    assert at(moves.resolve_sources(paths, journal)) == {"/c/a": "/p/a", "/c/b": "/c/b", "/c/d": "/o/d", "/c/e": "/c/e"}
    present = spark.createDataFrame([("/o/a",), ("/c/d",), ("/o/d",)], "path string")
    assert at(moves.resolve_sources(paths, journal, present)) == {"/c/a": "/o/a", "/c/b": "/c/b", "/c/d": "/c/d", "/c/e": "/c/e"}


def test_counterpart_files(spark):
    plan = spark.createDataFrame([("1", "B", "matched", "x"), ("2", "a", "matched", "y"), ("3", "c", "unmatched", None)], "id string, stem string, status string, card_id string")
    kind = "array<struct<path:string,rel_path:string,size:bigint>>"
    card = spark.createDataFrame([("x", [("/k/d/B.nef", "d/B.nef", 5)], [("/k/d/B.xmp", "d/B.xmp", 1), ("/k/d/B.xmp", "d/B.xmp", 1)]), ("y", [("/k/a.jpg", "a.jpg", 2)], None)], f"card_id string, files {kind}, sidecars {kind}")
    got = sorted(tuple(r) for r in counterpart.counterpart_transfers(plan, card, "/out").select("asset_id", "source", "target", "size").collect())
    assert got == [("1", "/k/d/B.nef", "/out/d/B.nef", 5), ("1", "/k/d/B.xmp", "/out/d/B.xmp", 1), ("2", "/k/a.jpg", "/out/a.jpg", 2)]
    assert [r.id for r in counterpart.matches_in_order(plan).collect()] == ["2", "1"]


def test_decisions(spark):
    schema = "asset_id string, decision string, note string, updated_at bigint"
    old = spark.createDataFrame([("a", "keep", None, 1), ("b", "reject", None, 1)], schema)
    new = spark.createDataFrame([("a", None, " ", 2), ("c", None, "look", 2), ("b", "keep", None, 0)], schema)
    assert {(r.asset_id, r.decision) for r in review.upsert_decisions(old, new).collect()} == {("b", "keep"), ("c", None)}


def test_options():
    assert options.from_seconds(60, 60.0004).max_cluster_span_ms == 60_000
    assert options.ScanOptions(max_duplicate_distance=7).normalized().max_duplicate_distance == 1.0
    assert options.preset_of(options.preset("best", "browser"), "browser") == "best" and options.preset_of(options.ScanOptions(preview_size=7)) == "custom"
    assert not options.ScanOptions(refine_size=100).refines
    old = options.ScanOptions(detector="ml_heavy", acceleration="open_cl", detector_device="cuda").normalized()
    assert (old.detector, old.detector_model, old.acceleration, old.detector_device) == ("ml", "accurate", "portable", "gpu")
    assert options.ScanOptions(detector="vision").normalized().detector_model == "fast"
    assert abs(options.estimated_load(options.ScanOptions(), 16, 16.0) - (0.42 + 0.40 + 0.18 * 0.45) / 4) < 1e-12
    assert options.estimated_load(options.preset("best"), 1, 1.0) == 1.0 and options.estimated_load(options.ScanOptions(refine=False, detector="off"), 8, 8.0) < 0.45


def test_decimals_are_those_of_the_exact_value(spark):
    r = random.Random(3)
    values = [0.35, 2.675, 0.125, 0.375, 2.5, 3.5, 0.5, 1.5, 1e-300, 0.05, 0.15, 0.25, 1.005, 1023.95, 0.0, 4.35, 2.0**52, 1e12 + 0.3, 999999.995, -2.675, -0.04]
    values += [r.choice([r.random(), r.random() * 1000, round(r.random() * 100, 3), r.randrange(10**6) / 64, r.random() * 1e9]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3):
        got = df.select("x", C.fixed(F.col("x"), digits).alias("t")).collect()
        assert [r.t for r in got] == [f"{r.x:.{digits}f}" for r in got]
    odd = spark.createDataFrame([(None,), (float("inf"),), (float("-inf"),), (float("nan"),)], "x double").select(C.fixed(F.col("x"), 1).alias("t"))
    assert [r.t for r in odd.collect()] == [None, "inf", "-inf", "NaN"]
