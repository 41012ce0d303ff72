"""A folder of pictures, from listing to moves."""

import json
import os

import pytest
from conftest import png, pose

from framesift import scan
from framesift.options import ScanOptions
from framesift.operators import review
from framesift.sources import runs, transfers


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("card") / "burst"
    root.mkdir()
    for i, frame in enumerate([pose(90), pose(220), pose(220, vertical=True)]):
        path = root / f"frame_000{i}.png"
        path.write_bytes(png(frame))
        os.utime(path, (1_700_000_000 + i / 10,) * 2)
    (root / "frame_0003.png").write_bytes(b"not a picture")
    os.utime(root / "frame_0003.png", (1_700_000_000.3,) * 2)
    (root / "frame_0000.xmp").write_bytes(b"sidecar")
    return str(root), scan.scan(spark, str(root), ScanOptions()).cache()


def test_scan_finds_one_burst_and_two_stacks(scanned):
    rows = {r.stem: r for r in scanned[1].collect()}
    assert len({r.burst_id for r in rows.values()}) == 1
    good = [r for r in rows.values() if r.error is None]
    assert len({r.stack_id for r in good}) >= 2 and sum(r.action == "keep" for r in good) >= 2
    assert rows["frame_0003"].action == "error" and rows["frame_0003"].score == 0.0 and rows["frame_0003"].stack_size == 1
    assert rows["frame_0000"].sidecars == ["frame_0000.xmp"] and rows["frame_0000"].explanations[0].startswith("Ranked ")


def test_run_folder_round_trip(spark, scanned, tmp_path):
    root, frames = scanned
    folder = runs.write_run(frames, str(tmp_path / runs.run_name()), root)
    assert runs.read_manifest(folder)["summary"]["frames"] == 4 and runs.read_frames(spark, folder).count() == 4
    one = frames.where("error IS NULL").orderBy("stem").first().id
    new = spark.createDataFrame([(one, "reject", None, 1)], runs.DECISIONS)
    runs.write_decisions(review.upsert_decisions(runs.read_decisions(spark, folder), new), folder)
    decisions = runs.read_decisions(spark, folder)
    assert decisions.count() == 1
    runs.export_csvs(runs.read_frames(spark, folder), decisions, folder)
    count = lambda n: spark.read.csv(f"file://{folder}/csv/{n}", header=True).count()
    assert count("all_assets") == 4 and count("rejects") >= 1 and count("keepers") + count("rejects") + count("review") == 4
    state = json.load(open(f"{folder}/review.json"))
    state["run_created_at"] = "another"
    runs.write_json(f"{folder}/review.json", state)
    assert runs.read_decisions(spark, folder).count() == 0
    transfers.remove_run(folder)
    assert not os.path.exists(folder)


def test_moves_are_whole_and_reversible(spark, tmp_path):
    card, out, run = tmp_path / "card", tmp_path / "out", tmp_path / "run"
    card.mkdir(), run.mkdir()
    runs.write_json(f"{run}/manifest.json", {})
    for name, size in (("a.jpg", 10), ("a.nef", 9), ("b.jpg", 5)):
        (card / name).write_bytes(b"x" * size)
    plan = [transfers.Transfer("a", f"{card}/a.jpg", f"{out}/a.jpg", 10), transfers.Transfer("a", f"{card}/a.nef", f"{out}/a.nef", 9), transfers.Transfer("b", f"{card}/b.jpg", f"{out}/b.jpg", 5), transfers.Transfer("b", f"{card}/gone", f"{out}/gone", 5)]
    with pytest.raises(ValueError):
        transfers.move_assets(str(run), plan, confirm=False)
    report = transfers.move_assets(str(run), plan, confirm=True, source_root=str(card))
    assert report["moved"] == ["a"] and list(report["failed"]) == ["b"] and os.path.exists(card / "b.jpg") and not os.path.exists(card / "a.nef")
    assert transfers.move_assets(str(run), plan[:2], confirm=True)["skipped"] == ["a"]
    journal = runs.read_journal(spark, str(run))
    assert journal.where("restored_at IS NULL").count() == 2 and journal.first().source_rel_path == "a.jpg"
    moved = transfers.relocate_run(str(run), str(tmp_path / "elsewhere"))
    assert transfers.restore_assets(moved)["restored"] == ["a"] and os.path.getsize(card / "a.jpg") == 10
    runs.write_json(f"{moved}/moves.json", {"version": 1, "moves": [{"asset_id": "q", "source": "s", "destination": "d", "size": 1, "moved_at": "t"}]})
    assert runs.read_journal(spark, moved).first().source_set == "primary"
    runs.write_json(f"{moved}/moves.json", {"version": 2, "moves": []})
    with pytest.raises(ValueError):
        runs.read_journal(spark, moved)
    with pytest.raises(ValueError):
        transfers.check_destination(f"{card}/inner", str(card))


def test_targets_are_reserved_and_nothing_is_written_over(tmp_path):
    """Two files of a group, or of two groups, that want one name get two; a name taken meanwhile is an error, and no file is lost."""
    card, out, run = tmp_path / "card", tmp_path / "out", tmp_path / "run"
    (card / "x").mkdir(parents=True), (card / "y").mkdir(), run.mkdir()
    for name in ("x/a.jpg", "y/a.jpg", "a_1.jpg", "b.jpg"):
        (card / name).write_bytes(name.encode())
    move = lambda asset, name, to: transfers.Transfer(asset, f"{card}/{name}", f"{out}/{to}", len(name))
    plan = [move("1", "x/a.jpg", "a.jpg"), move("1", "y/a.jpg", "a.jpg"), move("2", "a_1.jpg", "a_1.jpg")]
    assert transfers.move_assets(str(run), plan, confirm=True)["moved"] == ["1", "2"]
    assert sorted(p.read_bytes() for p in out.iterdir()) == [b"a_1.jpg", b"x/a.jpg", b"y/a.jpg"]
    with pytest.raises(FileExistsError):
        transfers.copy_file(f"{card}/b.jpg", f"{out}/a.jpg", 5)
    assert (out / "a.jpg").read_bytes() == b"x/a.jpg" and (card / "b.jpg").exists()
    with pytest.raises(OSError):
        transfers.move_group([move("3", "b.jpg", "b.jpg"), move("3", "gone.jpg", "gone.jpg")])
    assert (card / "b.jpg").exists() and not (out / "b.jpg").exists()


def test_destinations_that_files_do_not_stay_in_are_refused(tmp_path):
    for bad in ("/tmp/x", "/var/tmp", "/card/x", "/card/y/../z"):
        with pytest.raises(ValueError):
            transfers.check_destination(bad, "/card")
    assert transfers.check_destination("/cards/../keep//here", "/card") == "/keep/here"
    assert transfers.check_destination("/cardinal", "/card", ("/mnt",)) == "/cardinal"


def test_relocation_is_verified(tmp_path, monkeypatch):
    run = tmp_path / "run"
    (run / "thumbs").mkdir(parents=True)
    runs.write_json(f"{run}/manifest.json", {"a": 1})
    (run / "thumbs/x").write_bytes(b"12345")
    os.symlink("x", run / "thumbs/link")
    with pytest.raises(ValueError):
        transfers.relocate_run(str(run), f"{run}/inner")
    with pytest.raises(ValueError):
        transfers.relocate_run(str(tmp_path), str(tmp_path / "other"))
    whole = transfers.shutil.copytree

    def lossy(source, target, *args, **options):
        whole(source, target, *args, **options)
        (tmp_path / "new.partial/thumbs/x").write_bytes(b"12")

    monkeypatch.setattr(transfers.shutil, "copytree", lossy)
    with pytest.raises(OSError):
        transfers.relocate_run(str(run), str(tmp_path / "new"))
    assert (run / "thumbs/x").read_bytes() == b"12345" and sorted(p.name for p in tmp_path.iterdir()) == ["run"]
    monkeypatch.setattr(transfers.shutil, "copytree", whole)
    (tmp_path / "new").mkdir()
    moved = transfers.relocate_run(str(run), str(tmp_path / "new"))
    assert moved == f"{tmp_path}/new 2" and not run.exists() and os.readlink(f"{moved}/thumbs/link") == "x"


def test_scripts_quote_names(spark, tmp_path):
    rejects = spark.createDataFrame([("/c/it's.jpg", "/o/it's.jpg")], "source string, target string")
    text = runs.move_script(rejects, str(tmp_path / "move.sh"))
    assert "'/c/it'\"'\"'s.jpg'" in text
    assert "'/c/it''s.jpg'" in runs.move_script(rejects, str(tmp_path / "move.ps1"), "powershell")


def test_thumbnails_and_review_export(spark, scanned, tmp_path):
    from framesift.sources import artifacts, images

    root, _ = scanned
    rasters = images.load_images(spark, root).withColumn("id", images.F.element_at(images.F.split("path", "/"), -1))
    made = artifacts.write_thumbnails(rasters, f"file://{tmp_path}", 64).collect()
    assert len(made) == 3 and all(os.path.getsize(r.file.removeprefix("file://")) > 50 for r in made)
    back = images.load_images(spark, f"{tmp_path}/thumbs").collect()
    assert {(r.width, r.height) for r in back} == {(64, 48)}
    decisions = spark.createDataFrame([("a", "keep", None, 1)], runs.DECISIONS)
    out = json.loads(artifacts.review_json(decisions, spark.createDataFrame([("b",)], "asset_id string"), root))
    assert out["decisions"][0]["decision"] == "keep" and out["move_status"]["asset_ids"] == ["b"]
    (tmp_path / "m").write_bytes(b"model")
    with pytest.raises(ValueError):
        artifacts.load_model(str(tmp_path / "m"), "0" * 64)
    (tmp_path / "x/y/z").mkdir(parents=True)
    artifacts.remove_empty_folders(str(tmp_path / "x/y/z"), str(tmp_path))
    assert not (tmp_path / "x").exists()


def test_decoders_fall_back_in_order(spark, tmp_path):
    """What Spark can't read, and RAW, goes to external decoders; their errors are told together."""
    from framesift.sources import decoders

    for name, data in (("a.png", png(pose(90))), ("b.png", b"no picture"), ("c.nef", b"P5 4 2 255 " + bytes(range(8))), ("d.cr2", b"bad"), ("e.txt", b"x")):
        (tmp_path / name).write_bytes(data)

    def broken(content):
        raise ValueError("out of order")

    external = [("first", broken), ("second", decoders.parse_ppm)]
    got = {os.path.basename(r.path): r for r in decoders.load_with_fallback(spark, str(tmp_path), external).collect()}
    assert got.keys() == {"a.png", "b.png", "c.nef", "d.cr2"}
    assert (got["a.png"].decoder, got["a.png"].error, got["a.png"].height) == ("native", None, 240)
    assert (got["c.nef"].decoder, got["c.nef"].width, got["c.nef"].data[:6]) == ("second", 4, bytes([0, 0, 0, 1, 1, 1]))
    assert got["d.cr2"].error.endswith("first: out of order; second: not an 8-bit PPM") and got["d.cr2"].error.startswith("external decoder failed for ")
    assert got["b.png"].error.startswith("native decode failed (") and got["b.png"].height == -1
    none = {os.path.basename(r.path): r.error for r in decoders.load_with_fallback(spark, str(tmp_path), []).collect()}
    assert "no external decoder found" in none["c.nef"] and none["a.png"] is None
    assert decoders.external_decoders({"convert": "/x/convert"}.get)[0][0] == "ImageMagick (/x/convert)" and decoders.external_decoders(lambda name: None) == []
    frames = scan.scan(spark, str(tmp_path), ScanOptions(refine=False), external=external).collect()
    assert {r.stem: r.action for r in frames}["d"] == "error" and {r.stem: r.error for r in frames}["c"] is None


def test_a_scan_tells_its_stages_and_can_be_called_off(spark, scanned):
    from framesift.progress import CancellationToken, Reporter, ScanCancelled

    heard, token = [], CancellationToken()
    reporter = Reporter(heard.append, token)
    frames = scan.scan(spark, scanned[0], ScanOptions(detector="heuristic"), reporter)
    assert [t["stage"] for t in reporter.timings] == ["analyzing", "grouping", "refining"] and reporter.timings[0]["items"] == 4
    assert [u.overall_fraction for u in heard] == sorted(u.overall_fraction for u in heard) and frames.count() == 4
    calls = Reporter(lambda u: token.cancel() if u.stage == "grouping" else None, token)
    with pytest.raises(ScanCancelled):
        scan.scan(spark, scanned[0], ScanOptions(), calls)
    with pytest.raises(ValueError):
        scan.scan(spark, scanned[0], ScanOptions(detector="crystal ball"))


def test_a_detector_is_merged_and_its_failure_is_not(spark, scanned):
    from framesift.functions import kernels
    from framesift.sources import images

    rasters = images.load_images(spark, scanned[0])
    measure = lambda *how: {r.path: r for r in images.score_images(rasters, 1280, *how).where("error IS NULL").collect()}
    plain, heuristic = measure(), measure("heuristic")
    found = measure("ml", lambda rgb, m: kernels.Detection(0.99, 1, 0.0, m.box))
    failed = measure("ml", lambda rgb, m: 1 / 0)
    for path, r in plain.items():
        assert found[path].object_confidence == pytest.approx(max(0.99, r.object_confidence)) and found[path].completeness >= r.completeness - 1e-9
        assert failed[path].object_confidence == heuristic[path].object_confidence and failed[path].completeness == heuristic[path].completeness
        assert found[path].subject_sharpness == pytest.approx(r.subject_sharpness) and found[path].subject_luma == r.subject_luma


def test_exports_follow_decisions(spark, scanned, tmp_path):
    from framesift.operators import reports
    from framesift.sources import decoders

    root, frames = scanned
    folder = runs.write_run(frames, str(tmp_path / "run"), root, {"workers": 3}, [{"stage": "analyzing", "elapsed_ms": 1.0}], decoders.capabilities(lambda name: None))
    one = frames.where("error IS NULL AND sidecars IS NOT NULL").orderBy("stem").first()
    new = spark.createDataFrame([(one.id, "reject", None, 1)], runs.DECISIONS)
    assert runs.save_decisions(spark, folder, new, "/elsewhere").count() == 1
    script = open(f"{folder}/move_rejects.sh").read()
    assert f"'{root}/frame_0000.png'" in script and "'/elsewhere/frame_0000.xmp'" in script and os.path.exists(f"{folder}/review.html")
    undo = spark.createDataFrame([(one.id, "keep", None, 2)], runs.DECISIONS)
    runs.save_decisions(spark, folder, undo, "/elsewhere")
    assert "frame_0000.png" not in open(f"{folder}/move_rejects.sh").read()
    loaded = runs.load_run(spark, folder)
    assert loaded["decisions"].first().decision == "keep" and loaded["move_status"] == {} and loaded["manifest"]["benchmarks"][0]["stage"] == "analyzing"
    assert reports.find_frames(loaded["frames"], [one.id]).count() == 1
    said = reports.diagnostics(loaded["manifest"])
    assert said["acceleration"] == "cpu_portable + spark (3)" and said["raw_decoder"].startswith("native compressed formats only")
    document = json.load(open(runs.write_document(spark, folder, f"{folder}/all.json")))
    assert len(document["frames"]) == 4 and document["summary"]["frames"] == 4 and len(document["bursts"]) == 1


def test_measures_that_are_no_numbers_are_left_out(spark):
    from framesift.operators import ranking

    df = spark.createDataFrame([("a", 1.0, "h"), ("b", float("nan"), "h"), ("c", float("inf"), "h"), ("d", None, "h")], "id string, sharpness double, dhash string")
    assert [r.id for r in ranking.finite(df, ["sharpness", "dhash"]).collect()] == ["a"]
