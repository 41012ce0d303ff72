"""Run folders: the manifest, decisions, move journal and exports of a scan."""

from __future__ import annotations

import html
import json
import os
import shutil
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.operators import moves, ranking, review
from framesift.progress import Reporter

JOURNAL = "asset_id string, source_set string, source_root string, source_rel_path string, source string, destination string, size bigint, moved_at string, restored_at string, idx bigint"
DECISIONS = "asset_id string, decision string, note string, updated_at bigint"
VERSION = 1
CSV_COLUMNS = (
    "id rel_path directory stem prefix seq time_ms capture_source width height burst_id stack_id stack_size rank score action final_action reason "
    "sharpness subject_sharpness contrast exposure_score completeness object_confidence nearest_distance duplicate_confidence"
).split()


def run_name(now: datetime | None = None) -> str:
    return (now or datetime.now(UTC)).strftime("run_%Y%m%d_%H%M%S")


def write_json(path: str, value) -> None:
    """The whole file or none: written beside, flushed, then renamed over."""
    beside = f"{path}.tmp"
    with open(beside, "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, indent=2)
        file.flush()
        os.fsync(file.fileno())
    os.replace(beside, path)


def write_run(frames: DataFrame, folder: str, root: str, options: dict | None = None, timings: list[dict] | None = None, capabilities: dict | None = None) -> str:
    """The run folder: frames, bursts and clusters as Parquet, and the manifest with counts, options, what was used, and the
    time of each stage. A run that fails leaves nothing."""
    os.makedirs(folder)
    try:
        frames.write.parquet(f"file://{folder}/frames")
        spark = frames.sparkSession
        written = spark.read.parquet(f"file://{folder}/frames")
        groups(written, "burst_id").write.parquet(f"file://{folder}/bursts")
        groups(written, "stack_id").write.parquet(f"file://{folder}/clusters")
        summary = ranking.action_summary(written).first().asDict()
        manifest = {"version": VERSION, "created_at": datetime.now(UTC).isoformat(), "root": root, "options": options or {}, "summary": summary, "benchmarks": timings or [], **(capabilities or {})}
        write_json(f"{folder}/manifest.json", manifest)
        write_launcher(folder)
    except BaseException:
        shutil.rmtree(folder, ignore_errors=True)
        raise
    return folder


def groups(frames: DataFrame, key: str) -> DataFrame:
    """A row for each burst or stack: its frames in order, its time bounds and, where there are ranks, its best frame."""
    members = F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda m: m["id"])
    best = F.max(F.when(F.col("rank") == 1, F.col("id")))
    return frames.groupBy(key).agg(members.alias("asset_ids"), F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), best.alias("best_asset_id"))


def write_document(spark: SparkSession, folder: str, target: str) -> str:
    """One JSON document with the manifest, all bursts, clusters and frames, for readers that want a single file. Rows stream
    through the driver; the document appears when it is whole."""
    parts = {"bursts": "burst_id", "clusters": "stack_id", "frames": "pos"}
    beside = f"{target}.tmp"
    with open(beside, "w", encoding="utf-8") as file:
        file.write(json.dumps(read_manifest(folder), ensure_ascii=False)[:-1])
        for name in parts:
            rows = spark.read.parquet(f"file://{folder}/{name}")
            order = ["burst_id", "pos"] if name == "frames" else [parts[name]]
            file.write(f', "{name}": [')
            for i, row in enumerate(rows.orderBy(*order).select(F.to_json(F.struct("*")).alias("row")).toLocalIterator()):
                file.write((",\n" if i else "\n") + row["row"])
            file.write("]")
        file.write("}\n")
    os.replace(beside, target)
    return target


def write_launcher(folder: str) -> None:
    """A page that says how this run is looked through."""
    lines = ["<!doctype html>", '<meta charset="utf-8">', f"<title>{html.escape(os.path.basename(folder))}</title>", "<h1>Review of this run</h1>", "<p>Read it with <code>framesift.sources.runs.load_run</code>; the lists are under <code>csv</code>.</p>"]
    Path(folder, "review.html").write_text("\n".join(lines) + "\n", encoding="utf-8")


def load_run(spark: SparkSession, folder: str, reporter: Reporter | None = None) -> dict:
    """All that a review begins with: manifest, frames, decisions of this run, and which assets have active moves."""
    reporter = reporter or Reporter()
    manifest = reporter.stage("reading_manifest", lambda: read_manifest(folder))
    if manifest.get("version") != VERSION:
        raise ValueError(f"manifest of version {manifest.get('version')}; this reads version {VERSION}")
    decisions = reporter.stage("loading_decisions", lambda: read_decisions(spark, folder), lambda df: df.count())
    status = reporter.stage("loading_move_history", lambda: {r["source_set"]: r.asDict() for r in moves.move_status(read_journal(spark, folder)).collect()})
    reporter.emit("preparing_review", 0, 1)
    return {"folder": folder, "manifest": manifest, "frames": read_frames(spark, folder), "decisions": decisions, "move_status": status}


def save_decisions(spark: SparkSession, folder: str, updates: DataFrame, destination: str | None = None) -> DataFrame:
    """Decisions after updates, written, and every export of the run made anew from them."""
    decided = review.upsert_decisions(read_decisions(spark, folder), updates)
    write_decisions(decided, folder)
    refresh_exports(spark, folder, destination)
    return read_decisions(spark, folder)


def refresh_exports(spark: SparkSession, folder: str, destination: str | None = None) -> None:
    """CSVs, move scripts (to ``destination``, or a folder beside the root) and the launcher, as the decisions are now."""
    frames, decisions, root = read_frames(spark, folder), read_decisions(spark, folder), read_manifest(folder)["root"].rstrip("/")
    export_csvs(frames, decisions, folder)
    rejects = review.with_decisions(frames, decisions).where("operation_action = 'reject'")
    each = F.explode(F.array_union("files", F.coalesce("sidecars", F.array().cast("array<string>")))).alias("rel_path")
    plan = moves.plan_targets(rejects.select(F.col("id").alias("asset_id"), each), destination or f"{root}_rejects", F.struct("asset_id", "rel_path"))
    sources = plan.select(F.concat(F.lit(root + "/"), "rel_path").alias("source"), "target")
    move_script(sources, f"{folder}/move_rejects.sh")
    move_script(sources, f"{folder}/move_rejects.ps1", "powershell")
    write_launcher(folder)


def read_manifest(folder: str) -> dict:
    with open(f"{folder}/manifest.json", encoding="utf-8") as file:
        return json.load(file)


def read_frames(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"file://{folder}/frames")


def read_journal(spark: SparkSession, folder: str) -> DataFrame:
    """The move journal, empty if there is none; fields that older ones lack take their defaults."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(journal_rows(folder))], JOURNAL)


def journal_rows(folder: str) -> list[tuple]:
    path = f"{folder}/moves.json"
    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as file:
        state = json.load(file)
    if state.get("version") != VERSION:
        raise ValueError(f"move journal of version {state.get('version')}; this reads version {VERSION}")
    get = lambda m, k, d=None: m.get(k, d)
    return [
        (m["asset_id"], get(m, "source_set", "primary"), get(m, "source_root"), get(m, "source_rel_path"), m["source"], m["destination"], m["size"], m["moved_at"], get(m, "restored_at"))
        for m in state["moves"]
    ]


def write_journal(folder: str, rows: list[tuple]) -> None:
    names = [f.split()[0] for f in JOURNAL.split(", ")][:-1]
    write_json(f"{folder}/moves.json", {"version": VERSION, "moves": [dict(zip(names, r)) for r in rows]})


def read_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions made for this run; those of another run that had the folder before don't count."""
    path = f"{folder}/review.json"
    rows, run = [], read_manifest(folder)["created_at"]
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            state = json.load(file)
        if state["run_created_at"] == run:
            rows = [(d["asset_id"], d.get("decision"), d.get("note"), d["updated_at"]) for d in state["decisions"]]
    return spark.createDataFrame(rows, DECISIONS)


def write_decisions(decisions: DataFrame, folder: str) -> None:
    rows = [r.asDict() for r in decisions.select("asset_id", "decision", "note", "updated_at").orderBy("asset_id").collect()]
    write_json(f"{folder}/review.json", {"run_created_at": read_manifest(folder)["created_at"], "decisions": rows})


def export_csvs(frames: DataFrame, decisions: DataFrame, folder: str) -> None:
    """All frames, and each in one of keepers, rejects and review; then a row for each burst and stack."""
    decided = review.with_decisions(frames.withColumn("rel_path", F.col("representative")), decisions)
    rows = decided.select(*CSV_COLUMNS).withColumn("file", review.export_file(F.col("final_action")))
    rows.drop("file").write.mode("overwrite").csv(f"file://{folder}/csv/all_assets", header=True)
    for name in ("keepers", "rejects", "review"):
        rows.where(F.col("file") == name).drop("file").write.mode("overwrite").csv(f"file://{folder}/csv/{name}", header=True)
    for name, key in (("bursts", "burst_id"), ("clusters", "stack_id")):
        members = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda m: m["id"]), "|")
        best = F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("id"))), F.lit(""))
        out = frames.groupBy(key).agg(members.alias("asset_ids"), F.min("time_ms").alias("start_ms"), F.max("time_ms").alias("end_ms"), best.alias("best_asset_id"))
        out.write.mode("overwrite").csv(f"file://{folder}/csv/{name}", header=True)


def posix_quote(text: str) -> str:
    return "'" + text.replace("'", "'\"'\"'") + "'"


def powershell_quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def move_script(rejects: DataFrame, target: str, shell: str = "posix") -> str:
    """A script that moves rejected files and stops at the first that fails. rejects: (source, target)."""
    pairs = rejects.select("source", "target").orderBy("source").toLocalIterator()
    if shell == "posix":
        lines = ["#!/bin/sh", "set -eu"]
        for source, to in pairs:
            s, t, d = posix_quote(source), posix_quote(to), posix_quote(str(Path(to).parent))
            lines.append(f"mkdir -p {d}; cp -p {s} {t}; cmp -s {s} {t} || {{ rm -f {t}; exit 1; }}; rm {s}")
    else:
        lines = ["$ErrorActionPreference = 'Stop'"]
        for source, to in pairs:
            s, t, d = powershell_quote(source), powershell_quote(to), powershell_quote(str(Path(to).parent))
            lines.append(f"New-Item -ItemType Directory -Force {d} | Out-Null; Copy-Item {s} {t}; if ((Get-FileHash {s}).Hash -ne (Get-FileHash {t}).Hash) {{ Remove-Item {t}; throw 'copy differs' }}; Remove-Item {s}")
    text = "\n".join(lines) + "\n"
    Path(target).write_text(text, encoding="utf-8")
    return text


def markdown_table(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    rows = df.collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])
