"""Bursts of frames that arrive as a stream.

``stream_bursts`` takes frames that come in order within a (directory, prefix): the state of a key is where its burst began,
the last frame, and how many bursts it has had, and a frame is given its burst as soon as it comes. ``stream_late_bursts``
takes frames that may come late: a frame waits until the watermark says that none before it is still to come, frames are
then given their bursts in order of time, and a key that has been silent for longer than any burst lasts is forgotten.
With the same order both give what ``operators.bursts`` gives for the whole table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framesift.options import ScanOptions

STATE = "start_ms bigint, last_ms bigint, last_seq bigint, burst_no bigint"
OUT = "directory string, prefix string, seq bigint, time_ms bigint, stem string, burst_no bigint, burst_start boolean"


def stream_bursts(frames: DataFrame, options: ScanOptions) -> DataFrame:
    """frames: streaming (directory, prefix, seq, time_ms, stem)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, last_seq, number = state.get if state.exists else (None, None, None, 0)
        rows = pd.concat(batches).astype(object)
        rows = rows.where(rows.notna(), None)
        rows["__s"] = [-1 if s is None else s for s in rows["seq"]]
        rows["__t"] = [(1 << 63) - 1 if t is None else t for t in rows["time_ms"]]
        rows = rows.sort_values(["__s", "__t", "stem"], kind="stable")
        numbers, starts = [], []
        for seq, now in zip(rows["seq"], rows["time_ms"]):
            new = number == 0
            if now is not None and last is not None:
                new = new or abs(now - last) > options.max_time_gap_ms or (start is not None and abs(now - start) > options.max_cluster_span_ms)
            new = new or (seq is not None and last_seq is not None and seq - last_seq > options.max_seq_gap)
            if new:
                number, start = number + 1, now
            last, last_seq = now, seq
            numbers.append(number)
            starts.append(new)
        state.update((start, last, last_seq, number))
        out = rows.drop(columns=["__s", "__t"])
        out["directory"], out["prefix"], out["burst_no"], out["burst_start"] = key[0], key[1], numbers, starts
        yield out[["directory", "prefix", "seq", "time_ms", "stem", "burst_no", "burst_start"]]

    return frames.groupBy("directory", "prefix").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


LATE_STATE = "start_ms bigint, last_ms bigint, last_seq bigint, waiting string"
LATE_OUT = "directory string, prefix string, seq bigint, time_ms bigint, stem string, burst_ms bigint, burst_start boolean"


def stream_late_bursts(frames: DataFrame, options: ScanOptions, lateness_ms: int) -> DataFrame:
    """frames: streaming (directory, prefix, seq, time_ms, stem), up to ``lateness_ms`` late. Each frame comes out with burst_ms, the
    time of its burst's first frame, and whether it is that frame.

    A key holds the frames of the last ``lateness_ms`` at most. Frames that are later than that are dropped by the watermark, as
    frames without a time are, which no watermark can place.
    """
    longest = max(options.max_time_gap_ms, options.max_cluster_span_ms)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, last_seq, waiting = state.get if state.exists else (None, None, None, "[]")
        rows = [tuple(r) for r in json.loads(waiting)]
        for batch in batches:
            rows += [(int(t), None if pd.isna(s) else int(s), stem) for t, s, stem in zip(batch["time_ms"], batch["seq"], batch["stem"])]
        sure = state.getCurrentWatermarkMs()
        rows.sort(key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
        ready = [r for r in rows if r[0] <= sure]
        rows = rows[len(ready) :]
        out = []
        for now, seq, stem in ready:
            new = start is None or now - last > options.max_time_gap_ms or now - start > options.max_cluster_span_ms
            new = new or (seq is not None and last_seq is not None and seq - last_seq > options.max_seq_gap)
            start, last, last_seq = now if new else start, now, seq
            out.append((key[0], key[1], seq, now, stem, start, new))
        if not rows and last is not None and last + longest < sure:
            state.remove()  # whatever comes begins a new burst
        else:
            state.update((start, last, last_seq, json.dumps(rows)))
            state.setTimeoutTimestamp(max(sure + 1, rows[0][0] if rows else last + longest + 1))
        if out:
            made = pd.DataFrame(out, columns=[f.split()[0] for f in LATE_OUT.split(", ")])
            made["seq"] = made["seq"].astype("Int64")
            yield made

    timed = frames.where("time_ms IS NOT NULL").withColumn("at", F.timestamp_millis("time_ms")).withWatermark("at", f"{lateness_ms} milliseconds")
    return timed.groupBy("directory", "prefix").applyInPandasWithState(step, LATE_OUT, LATE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
