"""Moving files by a plan, an asset at a time: all of its files or none, checked, and written to the journal."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from datetime import UTC, datetime
from pathlib import Path
from typing import NamedTuple

from framesift.sources import runs


class Transfer(NamedTuple):
    asset_id: str
    source: str
    target: str
    size: int


def temporary_roots() -> tuple[str, ...]:
    """Folders that systems empty by themselves."""
    return (tempfile.gettempdir(), "/tmp", "/private/tmp", "/var/tmp")


def inside(path: str, folder: str) -> bool:
    """Whether a path is the folder or under it, by name alone: links are not followed."""
    path, folder = os.path.normpath(os.path.abspath(path)), os.path.normpath(os.path.abspath(folder))
    return path == folder or path.startswith(folder.rstrip(os.sep) + os.sep)


def check_destination(destination: str, source_root: str, temporary: tuple[str, ...] | None = None) -> str:
    """The absolute destination; one inside the source, or in a folder for temporary files, is refused."""
    if inside(destination, source_root):
        raise ValueError(f"the destination is inside the source folder {source_root}")
    for folder in temporary_roots() if temporary is None else temporary:
        if inside(destination, folder):
            raise ValueError(f"the destination is in {folder}, where files do not stay")
    return os.path.normpath(os.path.abspath(destination))


def free_target(target: str, reserved: set[str]) -> str:
    """The target, or with _1, _2 ... before its extension the first that isn't there and that nobody has reserved; it is
    reserved then."""
    path, n = Path(target), 0
    while path.exists() or str(path) in reserved:
        n += 1
        path = Path(target).with_name(f"{Path(target).stem}_{n}{Path(target).suffix}")
    reserved.add(str(path))
    return str(path)


def copy_file(source: str, target: str, size: int) -> None:
    """A whole copy under a name that was free, or none: nothing is written over."""
    if os.path.getsize(source) != size:
        raise OSError(f"{source} has changed since it was listed")
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "xb"):  # an error if somebody else has taken the name
        pass
    try:
        shutil.copy2(source, target)
        if os.path.getsize(target) != size:
            raise OSError(f"the copy of {source} isn't whole")
    except OSError:
        os.unlink(target)
        raise


def move_group(group: list[Transfer]) -> None:
    """All files of one asset: every copy is made and checked before the first source goes. If a copy fails, all copies go; if a
    source can't be deleted, those already gone come back and the copies go."""
    made: list[Transfer] = []
    gone: list[Transfer] = []
    try:
        for t in group:
            copy_file(t.source, t.target, t.size)
            made.append(t)
        for t in group:
            os.unlink(t.source)
            gone.append(t)
    except OSError:
        for t in gone:
            shutil.copy2(t.target, t.source)
        for t in made:
            os.unlink(t.target)
        raise


def by_asset(plan: list[Transfer]) -> dict[str, list[Transfer]]:
    groups: dict[str, list[Transfer]] = {}
    for t in plan:
        groups.setdefault(t.asset_id, []).append(t)
    return groups


def move_assets(folder: str, plan: list[Transfer], confirm: bool, source_set: str = "primary", source_root: str | None = None) -> dict:
    """Run a plan: assets with an active move are left, missing or failing ones are reported, the rest are moved and journalled."""
    if not confirm:
        raise ValueError("moving files needs confirmation")
    rows = runs.journal_rows(folder)
    active = {r[0] for r in rows if r[8] is None and r[1] == source_set}
    reserved: set[str] = set()
    report = {"moved": [], "skipped": [], "failed": {}}
    for asset, group in by_asset(plan).items():
        if asset in active:
            report["skipped"].append(asset)
            continue
        try:
            if missing := [t.source for t in group if not os.path.isfile(t.source)]:
                raise OSError(f"missing: {', '.join(missing)}")
            group = [t._replace(target=free_target(t.target, reserved)) for t in group]
            move_group(group)
        except OSError as e:
            report["failed"][asset] = str(e)
            continue
        now = datetime.now(UTC).isoformat()
        rows += [(asset, source_set, source_root, os.path.relpath(t.source, source_root) if source_root else None, t.source, t.target, t.size, now, None) for t in group]
        runs.write_journal(folder, rows)
        report["moved"].append(asset)
    return write_report(folder, "move", report)


def restore_assets(folder: str, asset_ids: list[str] | None = None, source_set: str = "primary", source_root: str | None = None) -> dict:
    """Undo active moves, by asset. A file that is in the way, or a copy that is gone, leaves the asset as it is.

    ``source_root`` is where a source set is mounted now, if that has changed.
    """
    rows = runs.journal_rows(folder)
    report = {"restored": [], "failed": {}}
    at: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        if r[8] is None and r[1] == source_set and (asset_ids is None or r[0] in asset_ids):
            at.setdefault(r[0], []).append(i)
    for asset, places in at.items():
        home = [os.path.join(source_root, rows[i][3]) if source_root and rows[i][3] else rows[i][4] for i in places]
        try:
            if taken := [h for h in home if os.path.exists(h)]:
                raise OSError(f"in the way: {', '.join(taken)}")
            move_group([Transfer(asset, rows[i][5], h, rows[i][6]) for i, h in zip(places, home)])
        except OSError as e:
            report["failed"][asset] = str(e)
            continue
        now = datetime.now(UTC).isoformat()
        for i in places:
            rows[i] = (*rows[i][:8], now)
        runs.write_journal(folder, rows)
        report["restored"].append(asset)
    return write_report(folder, "restore", report)


def write_report(folder: str, operation: str, report: dict) -> dict:
    os.makedirs(f"{folder}/move_reports", exist_ok=True)
    runs.write_json(f"{folder}/move_reports/{operation}_{datetime.now(UTC):%Y%m%d_%H%M%S_%f}.json", report)
    return report


def tree_digests(folder: str) -> dict[str, str]:
    """SHA-256 of every file under a folder by its path there; a link counts as what it points to by name."""
    found = {}
    for base, folders, files in os.walk(folder):
        for name in [*files, *[f for f in folders if os.path.islink(os.path.join(base, f))]]:
            path = os.path.join(base, name)
            if os.path.islink(path):
                found[os.path.relpath(path, folder)] = "link:" + os.readlink(path)
            else:
                with open(path, "rb") as file:
                    found[os.path.relpath(path, folder)] = hashlib.file_digest(file, "sha256").hexdigest()
    return found


def relocate_run(folder: str, target: str) -> str:
    """Move a run folder; destinations in its journal that lay inside follow it.

    The copy is made beside the target, compared file by file, and takes its name only when it is whole; the old folder goes
    after that. A folder that isn't a run, or a target inside it, is refused.
    """
    check_run(folder)
    if inside(target, folder):
        raise ValueError(f"{target} is inside the run folder")
    if os.path.exists(target):
        n = 2
        while os.path.exists(f"{target} {n}"):
            n += 1
        target = f"{target} {n}"
    beside, rows = f"{target}.partial", runs.journal_rows(folder)
    try:
        shutil.copytree(folder, beside, symlinks=True)
        if tree_digests(beside) != tree_digests(folder):
            raise OSError(f"the copy of {folder} isn't whole")
        if rows:
            within = lambda d: d.startswith(folder.rstrip("/") + "/")
            runs.write_journal(beside, [(*r[:5], target + r[5][len(folder.rstrip("/")) :] if within(r[5]) else r[5], *r[6:]) for r in rows])
        os.rename(beside, target)
    except OSError:
        shutil.rmtree(beside, ignore_errors=True)
        raise
    shutil.rmtree(folder)
    return target


def check_run(folder: str) -> None:
    if os.path.islink(folder) or not os.path.isfile(f"{folder}/manifest.json"):
        raise ValueError(f"{folder} is not a run folder")


def remove_run(folder: str) -> None:
    """Delete a run folder; a link, or a folder that isn't a run, is refused."""
    check_run(folder)
    shutil.rmtree(folder)
