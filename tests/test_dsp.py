"""Kernels on synthetic signals."""

import io
import time
import tracemalloc
import wave

import numpy as np
import pyarrow as pa

from chronoloom.dsp import kernels as K
from chronoloom.dsp import plans

SR = 22050


def clicks(bpm, seconds):
    y = np.zeros(int(seconds * SR), np.float32)
    burst = np.linspace(1, 0, int(0.005 * SR)).astype(np.float32)
    for t in np.arange(0, seconds, 60 / bpm):
        i = int(t * SR)
        y[i : i + len(burst)] += burst[: len(y) - i]
    return y


def sine(seconds, amp=0.6, hz=220):
    return (amp * np.sin(2 * np.pi * hz * np.arange(int(seconds * SR)) / SR)).astype(np.float32)


def test_tempo_of_clicks():
    for bpm in (90, 120, 150):
        for tracker in ("beat", "plp"):
            a = K.analyse(clicks(bpm, 20), SR, tracker=tracker)
            assert abs(a["bpm"] - bpm) < 4 and abs(len(a["beats"]) - bpm / 3) <= 2 and max(a["energy"]) == 1.0
    assert K.analyse(np.zeros(SR * 3, np.float32), SR)["beats"] == []


def test_silence_between_tones():
    y = sine(13)
    y[5 * SR : 8 * SR] = 0
    y[10 * SR : int(10.5 * SR)] = 0
    (centre,) = K.silences(y, SR)
    assert abs(centre - 6.5) < 0.3
    assert K.silences(np.zeros(SR), SR) == []


def test_limiter():
    y = sine(1, 0.3)
    assert K.limit(y, SR)[1] == [] and np.allclose(K.limit(y, SR)[0], y)
    a, b = int(0.45 * SR), int(0.55 * SR)
    y[a:b] += 1.6 * np.sin(2 * np.pi * 6000 * np.arange(b - a) / SR).astype(np.float32)
    cleaned, (region,) = K.limit(y, SR)
    assert region["peak_amp"] > 1 and region["max_gr_db"] > 3 and np.abs(cleaned).max() < np.abs(y).max()
    assert len(K.limit(y[:0], SR)[0]) == 0


def test_sliding_max_is_the_maximum():
    x = np.random.default_rng(0).normal(size=200)
    for size in (1, 2, 7, 50, 200):
        assert np.array_equal(K._sliding_max(x, size), np.lib.stride_tricks.sliding_window_view(x, size).max(1))


def test_peaks_and_spectrogram():
    p = K.hop_peaks(np.full(SR, 0.5, np.float32), SR)
    assert len(p) == 100 and p.max() == 1.0
    hour = len(K.hop_peaks(np.ones(3600 * 2205, np.float32), 2205))
    assert abs(hour * 10 - 3_600_000) <= 20
    assert K.exact_hop(SR) == {"hop_us": 23220, "hop_ms": 23}
    assert K.spectrogram_cells(np.zeros(SR, np.float32), SR).max() == 0
    assert K.spectrogram_cells(sine(1), SR).max() == 255


def _median_by_windows(x, size, axis):
    pad = [(0, 0), (0, 0)]
    pad[axis] = (size // 2, size // 2)
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), size, axis=axis), axis=-1)


def test_running_medians():
    rng = np.random.default_rng(0)
    for size in (3, 5, 7, 11, 19, 31, 35):
        for shape in ((1, 1), (3, 40), (90, 5), (5, 2100)):
            for x in (rng.random(shape, np.float32), rng.integers(0, 9, shape).astype(np.float32) - 4):
                for axis in (0, 1):
                    assert np.array_equal(K._median_along(x, size, axis), _median_by_windows(x, size, axis)), (size, shape, axis)
    x = rng.random((40, 50), np.float32)
    x[7, 9] = np.nan
    assert np.array_equal(K._median_along(x, 31, 0), _median_by_windows(x, 31, 0), equal_nan=True)


def test_louder_across_frequency_than_along_time():
    """Upper bits decide most cells; ties of them, zeros, and numbers beyond them as the whole medians do."""
    rng = np.random.default_rng(0)
    close = (1 + rng.random((60, 50)) / 100) * rng.choice([1, 2], (60, 50))
    for x in (rng.random((60, 50)), np.exp2(rng.integers(-3, 4, (60, 50))), close, rng.random((60, 50)) * rng.integers(0, 2, (60, 50)), rng.random((60, 50)) * 1e-38, rng.random((60, 50)) * 3e38, np.zeros((60, 50))):
        x = x.astype(np.float32)
        for margin in (2.0, 1.5):
            with np.errstate(over="ignore"):
                want = _median_by_windows(x, 31, 1) > margin * _median_by_windows(x, 31, 0)
                assert np.array_equal(K._louder_across(x, 31, margin), want)


def test_medians_take_a_part_of_the_time_of_sorting_each_window():
    x = np.random.default_rng(0).random((186, 1025), np.float32)

    def took(f):
        t = time.process_time()
        f(x, 31, 1)
        return time.process_time() - t

    assert min(took(K._median_along) for _ in range(5)) < 0.5 * min(took(_median_by_windows) for _ in range(3))


def test_transform_holds_little_besides_its_result():
    y = np.zeros(512 * 4000, np.float32)
    tracemalloc.start()
    try:
        result = K.magnitudes(y).nbytes
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < result + 2 * y.nbytes


def test_segments_and_texture():
    assert K.segment(np.r_[np.zeros((10, 2)), np.ones((7, 2)), np.zeros((5, 2))], 3) == [0, 10, 17]
    y = np.concatenate([sine(20, hz=200), np.random.default_rng(0).normal(0, 0.2, 20 * SR).astype(np.float32)])
    assert any(abs(b - 20) < 2 for b in K.boundaries(y, SR, 20))
    beat, tone = K.texture(clicks(120, 6), SR), K.texture(sine(6), SR)
    assert beat["percussive"] > 0.5 > tone["percussive"] and beat["rms_cv"] > tone["rms_cv"]
    assert K.texture(sine(0.5), SR)["flux"] is None


def wav_bytes(y):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, SR, 0, "NONE", ""))
        w.writeframes((y * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_signals_are_made_where_they_are_analysed(spark):
    """Samples never pass from one Python worker to another; made ones give what a table of the same ones gives."""
    from chronoloom.plans import catalog

    for name, workers in (("dsp_beats", 1), ("dsp_textures", 1), ("dsp_spectrograms", 2)):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapIn") == workers and "sr#" not in plan, name
    made = plans.Made(spark.range(1, 9, 1, 1).withColumnRenamed("id", "track_id"), lambda b: ((i, 0, SR, 0, np.full(SR * i, 0.5, np.float32), float(i)) for i in b.column(0).to_pylist()))
    make = made.make
    table = made.rows.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"track_id": [t], "chunk_idx": pa.array([k], pa.int32()), "sr": pa.array([sr], pa.int32()), "start_ms": [at], "data": pa.array([y.tobytes()], pa.binary())}) for b in bs for t, k, sr, at, y, _ in make(b)), "track_id long, chunk_idx int, sr int, start_ms long, data binary")
    for operator in (plans.frame_features, plans.spectrograms, plans.textures):
        one, other = (sorted(map(repr, operator(x).collect())) for x in (made, table))
        assert one == other and len(one) >= 8


def test_plans(spark):
    files = spark.createDataFrame([("a", wav_bytes(clicks(120, 12))), ("b", b"no wave"), ("c", wav_bytes(sine(4)))], "path string, content binary")
    s = plans.read_samples(files, chunk_s=6.0)
    assert sorted((r.track_id, r.chunk_idx, r.start_ms, r.data is None) for r in s.collect()) == [("a", 0, 0, False), ("a", 1, 6000, False), ("b", 0, 0, True), ("c", 0, 0, False)]
    b = plans.beats(s).where("track_id = 'a'").collect()
    assert 20 <= len(b) <= 26 and max(r.at_ms for r in b) > 10_000
    assert {r.n_mels for r in plans.spectrograms(s).collect()} == {64}
    assert plans.peaks(s).count() == 3 and plans.textures(s).count() == 3 and plans.frame_features(s).count() > 100
    assert plans.limited(s).count() >= 0 and plans.segments(s, 2.0).count() > 0


def test_structural_run(spark):
    from chronoloom.plans import composites

    rng = np.random.default_rng(1)
    quiet = np.zeros(3 * SR // 4, np.float32)
    long = np.concatenate([clicks(120, 200) * 0.8, quiet.repeat(4), clicks(90, 200) + 0.05 * rng.normal(size=200 * SR).astype(np.float32), sine(120)])
    files = spark.createDataFrame([("a", wav_bytes(clicks(120, 20))), ("b", wav_bytes(long))], "path string, content binary")
    s = plans.read_samples(files).cache()
    run = composites.auto_chapter(s, target_minutes=2.0)
    ch = run.chapters.orderBy("track_id", "at_ms").collect()
    a, b = [r for r in ch if r.track_id == "a"], [r for r in ch if r.track_id == "b"]
    assert [(r.at_ms, r.end_ms) for r in a] == [(0, 20_000)]
    assert len(b) > 2 and b[0].at_ms == 0 and all(x.end_ms == y.at_ms for x, y in zip(b, b[1:])) and all(r.end_ms - r.at_ms <= 180_001 for r in b)
    beats = run.beats.where("track_id = 'a'").orderBy("seq").collect()
    assert 38 <= len(beats) <= 42 and [r.seq for r in beats] == list(range(len(beats)))
    assert {(r.voice_label, r.content_type in ("", "driving", "calm", "varied")) for r in ch} == {("", True)} and all(r.confidence > 0 for r in ch)
    assert run.stanzas.count() > 3 and run.energy.where("track_id = 'a'").first().bpm > 100
    assert composites.voice_ratio(s).first().voice_ratio == 0.0
    assert composites.voice_ratio(s, lambda block: 1.0).first().voice_label == "talk"


def test_resampling_keeps_what_fits_and_drops_the_rest():
    t = np.arange(44_100) / 44_100
    low, high = (np.sin(2 * np.pi * hz * t).astype(np.float32) for hz in (440, 15_000))
    a, b = K.resample(low, 44_100, SR), K.resample(high, 44_100, SR)
    assert len(a) == len(b) == SR and np.abs(b[500:-500]).max() < 0.05
    want = np.sin(2 * np.pi * 440 * np.arange(SR) / SR)
    assert np.abs(a[500:-500] - want[500:-500]).max() < 0.02


def test_chunks():
    aligned = 441 * 512
    assert plans.chunk_cuts(0, SR, 180) == [0] and plans.chunk_cuts(5 * SR, SR, 180) == [0]
    step = 180 * SR // aligned * aligned
    assert plans.chunk_cuts(2 * step + step // 2, SR, 180) == [0, step, 2 * step]
    assert plans.chunk_cuts(2 * step + step // 2 - 1, SR, 180) == [0, step]  # the runt joins the one before


def test_chunks_give_what_whole_tracks_give(spark):
    """Levels are normalised over the track, frames and hops run on over the cuts, at any recorded rate."""
    rng = np.random.default_rng(3)
    y = np.concatenate([0.05 * rng.normal(size=12 * SR), np.zeros(4 * SR), 0.5 * rng.normal(size=20 * SR)]).clip(-1, 1).astype(np.float32)
    files = spark.createDataFrame([("a", wav_bytes(y)), ("z", wav_bytes(np.zeros(12 * SR, np.float32)))], "path string, content binary")
    whole, cut = plans.read_samples(files), plans.read_samples(files, chunk_s=11.0)
    assert cut.where("track_id = 'a'").count() == 4

    def joined(df, column, to=lambda x: x):
        out = {}
        for r in df.orderBy("track_id", "chunk_idx").collect():
            out.setdefault(r.track_id, []).extend(to(r[column]))
        return out

    a, b = (joined(plans.peaks(s), "peaks") for s in (whole, cut))
    assert a == b and len(a["a"]) == 3600 and max(a["a"]) == 1.0
    a, b = (joined(plans.spectrograms(s, n_mels=16), "cells") for s in (whole, cut))
    assert {k: len(v) for k, v in a.items()} == {k: len(v) for k, v in b.items()} and max(b["z"]) == 0
    assert np.mean(np.abs(np.array(a["a"]) - np.array(b["a"])) > 1) < 0.01  # frames at the cuts see zeros beyond
    frames = plans.frame_features(cut).where("track_id = 'a'").collect()
    assert sorted(r.frame_idx for r in frames) == list(range(1 + len(y) // 512))
    from chronoloom.operators import structure

    # the quiet part is no silence beside its own chunk, but it is beside the track
    (centre,) = (r.centre for r in structure.silence_islands(plans.frame_features(cut).where("track_id = 'a'")).collect())
    assert abs(centre - 14.0) < 0.3


def test_slices(spark):
    y = (np.arange(20 * SR) / (20 * SR)).astype(np.float32)
    s = plans.read_samples(spark.createDataFrame([("a", wav_bytes(y))], "path string, content binary"), chunk_s=6.0)
    spans = spark.createDataFrame([("a", 0, 0, 5000), ("a", 1, 5000, 13_500), ("a", 2, 13_500, None), ("a", 3, 30_000, 31_000), ("b", 0, 0, 1)], "track_id string, span_idx int, start_ms long, end_ms long")
    got = {r.chunk_idx: r for r in plans.slices(s, spans).collect()}
    assert sorted(got) == [0, 1, 2] and sum(len(r.data) for r in got.values()) == 4 * len(y)
    for k, (a, e) in enumerate([(0, 5 * SR), (5 * SR, int(13.5 * SR)), (int(13.5 * SR), len(y))]):
        assert np.abs(np.frombuffer(got[k].data, "<f4") - y[a:e]).max() < 1e-3
    assert plans.beats(s.limit(0)).count() == 0
    short = spans.where("span_idx = 0").selectExpr("track_id", "span_idx", "start_ms", "900L as end_ms")
    assert plans.beats(plans.slices(s, short)).count() == 0
