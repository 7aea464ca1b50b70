"""Plans of the kernels over ``samples(track_id, chunk_idx, sr, start_ms, data binary of float32)``, one row per chunk.

Chunks of a few minutes bound a task's memory whatever a track's length is, and no shuffle moves samples but to cut them
anew (``slices``). Beats are found and normalised chunk by chunk, as the per-span analysis defines; levels (silence, peaks,
spectrograms) are normalised over the whole track, from features that are far smaller than samples. What depends on the
whole track's length takes it from the column track_s (double, seconds), which ``read_samples`` gives; without it, a chunk
counts as a track.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Mono float samples of a PCM WAVE value."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, sr = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width in (2, 4):
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / float(1 << (8 * width - 1))
    else:
        raise ValueError(f"{8 * width} bits a sample")
    return x.reshape(-1, channels).mean(1), sr


#: The one rate that samples are analysed at.
RATE = 22_050
#: Chunks are cut at multiples of both a frame's hop and 20 ms, so that frames and hops run on over the cuts.
ALIGNED = kernels.HOP * 441


def chunk_cuts(n: int, sr: int, chunk_s: float) -> list[int]:
    """Where the chunks of n samples begin; a last one under half a chunk joins the one before."""
    step = max(1, int(chunk_s * sr))
    step = step // ALIGNED * ALIGNED or step
    count = max(1, -(-n // step))
    if count > 1 and n - (count - 1) * step < step / 2:
        count -= 1
    return [k * step for k in range(count)]


def read_samples(files: DataFrame, *, chunk_s: float = 180.0, sr: int = RATE) -> DataFrame:
    """Chunks of ``files(path, content)`` (as the binaryFile source gives), mono and at the rate ``sr``; a file that can't be
    decoded gives one null chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    y, own = decode_wav(content)
                except (ValueError, EOFError, wave.Error):
                    yield pa.RecordBatch.from_pydict({"track_id": [path], "chunk_idx": pa.array([0], pa.int32()), "sr": pa.array([None], pa.int32()), "start_ms": [0], "data": pa.array([None], pa.binary()), "track_s": pa.array([None], pa.float64())})
                    continue
                y = kernels.resample(y, own, sr)
                cuts = chunk_cuts(len(y), sr, chunk_s)
                for k, (at, end) in enumerate(zip(cuts, [*cuts[1:], len(y)])):
                    yield pa.RecordBatch.from_pydict({"track_id": [path], "chunk_idx": pa.array([k], pa.int32()), "sr": pa.array([sr], pa.int32()), "start_ms": [at * 1000 // sr], "data": pa.array([y[at:end].astype("<f4").tobytes()], pa.binary()), "track_s": [len(y) / sr]})

    return files.select("path", "content").mapInArrow(run, "track_id string, chunk_idx int, sr int, start_ms long, data binary, track_s double")


def slices(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """``samples`` cut anew: one row for each of ``spans(track_id, span_idx, start_ms, end_ms)``, span_idx as its chunk_idx.

    Chunks are cut where they lie, and only the parts of a span meet, so a span should be no longer than a task can hold
    (chapters have a bound). Spans without samples give no row; null end_ms: the end of the track.
    """
    n = F.length("data") / 4
    own = samples.where("data is not null")
    own = own if "track_s" in own.columns else own.withColumn("track_s", n / F.col("sr"))
    s = spans.select(F.col("track_id").alias("__t"), "span_idx", F.col("start_ms").alias("a"), F.col("end_ms").alias("e"))
    first = F.rint(F.col("start_ms") * F.col("sr") / 1000)
    from_, to = F.rint(F.col("a") * F.col("sr") / 1000), F.coalesce(F.rint(F.col("e") * F.col("sr") / 1000), F.lit(2.0**52))
    met = own.join(s, (own["track_id"] == s["__t"]) & (from_ < first + n) & (to > first))
    left, right = F.greatest(F.lit(0), from_ - first), F.least(n, to - first)
    part = F.substring("data", (left * 4 + 1).cast("int"), ((right - left) * 4).cast("int"))
    parts = met.select("track_id", "span_idx", "a", "sr", "track_s", "chunk_idx", part.alias("data")).where(F.length("data") > 0)
    g = parts.groupBy("track_id", "span_idx", "a", "sr", "track_s").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", "data"))).alias("p"))
    data = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["data"]))
    return g.select("track_id", F.col("span_idx").cast("int").alias("chunk_idx"), "sr", F.col("a").alias("start_ms"), data.alias("data"), "track_s")


@dataclass(frozen=True)
class Made:
    """Samples that a worker makes of ``rows`` (which have a track_id) as it needs them: none pass between processes.

    make(batch) gives (track_id, chunk_idx, sr, start_ms, samples, track_s) for each chunk of a batch of rows. The operators
    that go chunk by chunk take it in place of a table of samples.
    """

    rows: DataFrame
    make: Callable[[pa.RecordBatch], Iterator[tuple]]


def _stored(samples: DataFrame) -> Made:
    """The chunks of a table, read where they lie in a batch; null ones are left out."""
    if "track_s" not in samples.columns:
        samples = samples.withColumn("track_s", F.length("data") / 4 / F.col("sr"))

    def make(b: pa.RecordBatch) -> Iterator[tuple]:
        for track, k, sr, at, data, s in zip(*b.columns):
            if data.is_valid:
                yield track.as_py(), k.as_py(), int(sr.as_py()), int(at.as_py()), np.frombuffer(data.as_buffer(), "<f4"), s.as_py()

    return Made(samples.select("track_id", "chunk_idx", "sr", "start_ms", "data", "track_s"), make)


def _key(samples: DataFrame | Made) -> str:
    rows = samples.rows if isinstance(samples, Made) else samples
    return rows.schema["track_id"].dataType.simpleString()


#: Rows of results, and samples looked at, after which a worker hands on what it has.
MOST_ROWS, MOST_SAMPLES = 4096, 1 << 22


def _per_chunk(samples: DataFrame | Made, rows, schema: str) -> DataFrame:
    """rows(y, sr, start_ms, track_s) gives dicts of a chunk's result; null chunks give none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = samples if isinstance(samples, Made) else _stored(samples)
    make = made.make
    full = f"track_id {_key(made)}, chunk_idx int, {schema}"
    form = to_arrow_schema(T.StructType.fromDDL(full))

    def packed(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type, from_pandas=True) for f in form], schema=form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, seen = [], 0
            for track, k, sr, at, y, s in make(b):
                out += [{"track_id": track, "chunk_idx": k, **row} for row in rows(y, sr, at, s)]
                seen += len(y)
                if out and (len(out) >= MOST_ROWS or seen >= MOST_SAMPLES):
                    yield packed(out)
                    out, seen = [], 0
            if out:
                yield packed(out)

    made.rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return made.rows.mapInArrow(run, full)


def beats(samples: DataFrame | Made, *, tracker: str = "auto", locked_bpm: float | None = None, source: str = "full") -> DataFrame:
    """Beats of each chunk of a second or more, by its own sound; shorter ones say nothing of a tempo."""

    def rows(y, sr, at, track_s):
        if len(y) < sr:
            return []
        own = ("plp" if track_s > 600 else "beat") if tracker == "auto" else tracker
        a = kernels.analyse(kernels.percussive(y) if source == "percussive" else y, sr, tracker=own, locked_bpm=locked_bpm)
        return [{"at_ms": b + at, "energy": e, "bpm": a["bpm"], "ref_bpm": a["ref_bpm"]} for b, e in zip(a["beats"], a["energy"])]

    if source not in ("full", "percussive"):
        raise ValueError(f"unknown source {source!r}")
    if tracker not in ("auto", "beat", "plp"):
        raise ValueError(f"unknown tracker {tracker!r}")
    if locked_bpm is not None and not 0 < locked_bpm < 1000:
        raise ValueError(f"locked_bpm must lie between 0 and 1000, not {locked_bpm!r}")
    return _per_chunk(samples, rows, "at_ms long, energy double, bpm double, ref_bpm double")


def _own_frames(y: np.ndarray, sr: int, at: int, track_s: float) -> tuple[int, int]:
    """The number, over the track, of a chunk's first frame, and how many are its own: the last one is the next chunk's first."""
    ends = at / 1000 + len(y) / sr >= track_s - 0.01
    return round(at * sr / 1000 / kernels.HOP), len(y) // kernels.HOP + (1 if ends else 0)


def frame_features(samples: DataFrame | Made) -> DataFrame:
    """Loudness of each frame; frames are numbered over the track, frame_s is their distance in seconds."""

    def rows(y, sr, at, track_s):
        first, n = _own_frames(y, sr, at, track_s)
        return [{"frame_idx": first + i, "rms": float(r), "frame_s": kernels.HOP / sr} for i, r in enumerate(kernels.frame_rms(y)[:n])]

    return _per_chunk(samples, rows, "frame_idx int, rms double, frame_s double")


def peaks(samples: DataFrame | Made, hop_ms: float = 10.0) -> DataFrame:
    """Peaks of each chunk over the loudest hop of its whole track; four decimals."""
    if hop_ms <= 0:
        raise ValueError("hop_ms must be positive")
    raw = _per_chunk(samples, lambda y, sr, at, track_s: [{"hop_ms": hop_ms, "raw": kernels.hop_rms(y, sr, hop_ms).tolist()}], "hop_ms double, raw array<double>")
    most = F.max(F.array_max("raw")).over(Window.partitionBy("track_id"))
    return raw.withColumn("most", most).select("track_id", "chunk_idx", "hop_ms", F.transform("raw", lambda x: F.when(F.col("most") > 0, F.round(x / F.col("most"), 4)).otherwise(x)).alias("peaks"))


def spectrograms(samples: DataFrame | Made, n_mels: int = 64, fmax: float = 8000.0, floor: float = -80.0, ceiling: float = 0.0) -> DataFrame:
    """Cells of each chunk's frames, in dB below the loudest cell of the whole track.

    Levels go through one window by track (a twelfth of the samples' bytes) to learn the loudest, then become bytes.
    """
    if not floor < ceiling:
        raise ValueError("floor must lie below ceiling")

    def rows(y, sr, at, track_s):
        _, n = _own_frames(y, sr, at, track_s)
        level = kernels.mel_level(y, sr, n_mels, fmax)[:n].astype("<f4")
        return [{"n_mels": n_mels, "n_frames": len(level), **kernels.exact_hop(sr), "top": float(level.max(initial=-100.0)), "level": level.tobytes()}]

    levels = _per_chunk(samples, rows, "n_mels int, n_frames int, hop_us long, hop_ms long, top double, level binary")
    levels = levels.withColumn("top", F.max("top").over(Window.partitionBy("track_id")))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["track_id", "chunk_idx", "n_mels", "n_frames", "hop_us", "hop_ms"]
        for b in batches:
            level = (np.frombuffer(x.as_buffer(), "<f4").reshape(-1, n_mels) for x in b.column("level"))
            found = [kernels.cells_of(x, top, floor, ceiling).tobytes() for x, top in zip(level, b.column("top").to_pylist())]
            yield pa.RecordBatch.from_arrays([*map(b.column, names), pa.array(found, pa.binary())], [*names, "cells"])

    return levels.mapInArrow(cells, f"track_id {_key(samples)}, chunk_idx int, n_mels int, n_frames int, hop_us long, hop_ms long, cells binary").withColumn("cells_b64", F.base64("cells"))


def limited(samples: DataFrame | Made) -> DataFrame:
    """Regions where the limiter works."""
    return _per_chunk(samples, lambda y, sr, at, track_s: [{**r, "start_s": r["start_s"] + at / 1000, "end_s": r["end_s"] + at / 1000} for r in kernels.limit(y, sr)[1]], "start_s double, end_s double, peak_amp double, max_gr_db double")


def textures(samples: DataFrame | Made) -> DataFrame:
    return _per_chunk(samples, lambda y, sr, at, track_s: [kernels.texture(y, sr)], "rms_cv double, percussive double, flux double")


def segments(samples: DataFrame | Made, target_s: float = 330.0) -> DataFrame:
    return _per_chunk(samples, lambda y, sr, at, track_s: [{"at": b + at / 1000} for b in kernels.boundaries(y, sr, target_s)], "at double")


def track_segments(samples: DataFrame | Made, target_s: float = 330.0) -> DataFrame:
    """(track_id, at): seconds at which about duration / target segments of a whole track begin, without 0.

    Only one row of features a second is gathered per track.
    """
    import pandas as pd

    def rows(y, sr, at, track_s):
        return [{"at": t + at / 1000, "track_s": track_s, "features": f} for t, f in kernels.pooled(y, sr)]

    def cut(key, f):
        f = f.sort_values("at")
        n = max(2, round(float(f["track_s"].max()) / target_s))
        at = f["at"].to_numpy()[[i for i in kernels.segment(np.array(f["features"].tolist()), n) if i]]
        return pd.DataFrame({"track_id": [key[0]] * len(at), "at": at})

    return _per_chunk(samples, rows, "at double, track_s double, features array<double>").groupBy("track_id").applyInPandas(cut, f"track_id {_key(samples)}, at double")
