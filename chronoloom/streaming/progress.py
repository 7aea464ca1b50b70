"""Streaming forms: progress events, gap sessions, the fire accumulator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "kind string, stage_path array<string>, progress double, elapsed_s double, ts timestamp"


def estimates(events: DataFrame, *, alpha: float = 0.3, delay: str = "1 hour") -> DataFrame:
    """Time left per stage of a stream of progress events (batch or stream): a learnt total, else proportion.

    State per stage path is one number, the exponential mean of the completed runs' durations; it goes an hour after
    the last event.
    """
    keyed = events.withColumn("path", F.array_join("stage_path", "/"))
    if events.isStreaming:
        keyed = keyed.withWatermark("ts", delay)

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = state.get[0] if state.exists else None
        rows = []
        for f in sorted(frames, key=lambda f: f.ts.min()):
            for e in f.sort_values("ts").itertuples():
                done = e.progress if e.progress == e.progress else None
                if e.kind == "complete" and e.elapsed_s == e.elapsed_s:
                    total = e.elapsed_s if total is None else alpha * e.elapsed_s + (1 - alpha) * total
                elif e.kind == "progress" and done is not None:
                    left = total * (1 - done) if total is not None else e.elapsed_s * (1 - done) / done if done > 0 else None
                    rows.append((key[0], e.ts, done, left))
        if total is not None:
            state.update((float(total),))
            state.setTimeoutDuration(3_600_000)
        if rows:
            yield pd.DataFrame(rows, columns=["path", "ts", "progress", "eta_s"])

    return keyed.groupBy("path").applyInPandasWithState(update, "path string, ts timestamp, progress double, eta_s double", "total double", "append", "ProcessingTimeTimeout")


def gap_sessions(points: DataFrame, gap: str = "150 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Spans of points (track_id, ts) at most ``gap`` apart, by Spark's session windows."""
    p = points.withWatermark("ts", delay) if points.isStreaming else points
    return p.groupBy("track_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("track_id", "w.start", "w.end", "n")


def fire(beats: DataFrame, full: float = 0.45) -> DataFrame:
    """The fire accumulator over a stream of beats (track_id, seq, arc) that arrive in order: state is one number a track."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        acc = state.get[0] if state.exists else 0.0
        rows = []
        for e in pd.concat(frames).sort_values("seq").itertuples():
            acc += min(1.0, e.arc / full)
            if acc >= 1.0:
                acc -= 1.0
                rows.append((key[0], e.seq))
        state.update((acc,))
        yield pd.DataFrame(rows, columns=["track_id", "seq"])

    return beats.groupBy("track_id").applyInPandasWithState(update, "track_id long, seq int", "acc double", "append", "NoTimeout")
