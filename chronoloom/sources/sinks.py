"""JSON documents out: one row per track, ready for a text sink; small single files by rename."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK


def omit(value: Column, default) -> Column:
    """Null where a field has its default; ``to_json`` then leaves it out."""
    return F.when(value.eqNullSafe(F.lit(default)), None).otherwise(value)


def chapter_text(c: str = "") -> Column:
    """A chapter's JSON: at_ms always, everything else only where it differs from its default."""
    f = lambda n: F.col(f"{c}{n}")
    return F.to_json(F.struct(f("at_ms").alias("at_ms"), f("end_ms").alias("end_ms"), *[omit(f(n), "").alias(n) for n in ("name", "intent", "content_type", "tone")], f("confidence").alias("confidence"), F.when(F.size(f("evidence")) > 0, f("evidence")).alias("evidence")))


def stanza_text() -> Column:
    return F.to_json(F.struct("chapter_idx", "at_ms", "end_ms", "mode", omit(F.col("source"), "").alias("source"), omit(F.col("tone"), "").alias("tone"), omit(F.col("auto_generated"), True).alias("auto_generated")))


def beat_maps(beats: DataFrame, tracks: DataFrame) -> DataFrame:
    """Beat-map documents of ``beats(track_id, seq, at_ms, energy)`` and ``tracks(track_id, bpm, duration_ms, damaged_after_ms)``; energies to six decimals."""
    row = F.array_sort(F.collect_list(F.struct("seq", "at_ms", F.round("energy", 6).alias("energy"))))
    b = beats.groupBy(TRACK).agg(row.alias("b"))
    at, e = F.transform("b", lambda x: x["at_ms"]), F.transform("b", lambda x: x["energy"])
    down = F.filter(at, lambda x, i: i % 4 == 0)
    doc = F.to_json(F.struct("bpm", "duration_ms", at.alias("beats"), down.alias("downbeats"), e.alias("energy"), "damaged_after_ms"))
    return tracks.join(b, TRACK).select(TRACK, doc.alias("doc"))


def peak_documents(peaks: DataFrame, by: str = "chronoloom") -> DataFrame:
    """Peak documents of ``peaks(track_id, chunk_idx, hop_ms, peaks)``: chunks in order, in one list."""
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "peaks"))), lambda x: x["peaks"]))
    p = peaks.groupBy(TRACK, "hop_ms").agg(joined.alias("peaks"))
    return p.select(TRACK, F.to_json(F.struct(F.lit("1.1").alias("version"), "hop_ms", F.rint(F.size("peaks") * F.col("hop_ms")).cast("long").alias("duration_ms"), "peaks", F.size("peaks").alias("peak_count"), F.lit(by).alias("generated_by"))).alias("doc"))


def spectrogram_documents(spectrograms: DataFrame, fmax: float = 8000.0, floor: float = -80.0, ceiling: float = 0.0, by: str = "chronoloom") -> DataFrame:
    """One document per track: its chunks' cells in order, as base64, with their exact hop and levels."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "n_frames", "cells")))
    g = spectrograms.groupBy(TRACK, "n_mels", "hop_us", "hop_ms").agg(parts.alias("p"))
    g = g.select("*", F.aggregate("p", F.lit(0), lambda n, x: n + x["n_frames"]).alias("n_frames"), F.base64(F.aggregate("p", F.lit(b""), lambda c, x: F.concat(c, x["cells"]))).alias("cells_b64"))
    duration = F.rint(F.col("n_frames") * F.col("hop_us") / 1000).cast("long").alias("duration_ms")
    levels = [F.lit(float(v)).alias(k) for k, v in (("fmax", fmax), ("db_floor", floor), ("db_ceiling", ceiling))]
    return g.select(TRACK, F.to_json(F.struct(F.lit("1.2").alias("version"), "hop_ms", "hop_us", "n_mels", "n_frames", duration, *levels, "cells_b64", F.lit(by).alias("generated_by"))).alias("doc"))


def latest(documents: DataFrame, version: str) -> DataFrame:
    """Documents (track_id, doc, written_at) whose version is current, the last of each track: what a resumed run may keep."""
    d = documents.where(F.get_json_object("doc", "$.version") == version)
    return d.withColumn("r", F.row_number().over(Window.partitionBy(TRACK).orderBy(F.desc("written_at")))).where("r = 1").drop("r")


def write_json_atomic(path: str, value, indent: int | None = 2) -> None:
    """One small document on the driver: a sibling file, flushed, then renamed over the target."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, name = tempfile.mkstemp(dir=folder, prefix=".write-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=indent, ensure_ascii=False, separators=(",", ":") if indent is None else None)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        if os.path.exists(name):
            os.unlink(name)
        raise


def publish(staged: str, slot: str | None, meta: dict) -> str:
    """Move a finished extraction into its cache slot and write its meta beside it; returns where to read from.

    A cache that can't be written never fails a run: without a slot, or if the move fails, that is the staged file.
    """
    try:
        if not slot:
            return staged
        os.replace(staged, slot)
    except OSError:
        return staged
    try:
        write_json_atomic(os.path.splitext(slot)[0] + ".json", meta)
    except OSError:
        pass  # the samples are what matters
    return slot


def owned_by_cache(path: str | None, folder: str) -> bool:
    """Whether a path is a cache slot, which the sweep owns, and no scratch file of this run."""
    return bool(path) and os.path.dirname(path) == folder.rstrip("/") and os.path.basename(path).startswith("fa-")
