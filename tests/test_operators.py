"""Golden cases: small inputs with values worked out by hand or by a plain Python version."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import curve, documents, merge, modes, shell, stats, structure, tempo, timeline

BEATS = "track_id long, seq int, at_ms long, energy double"


def beats(spark, at, energy=0.8, track=1):
    e = energy if isinstance(energy, list) else [energy] * len(at)
    return spark.createDataFrame([(track, i, t, float(x)) for i, (t, x) in enumerate(zip(at, e))], BEATS)


def actions(spark, pairs, track=1):
    return spark.createDataFrame([(track, i, t, p) for i, (t, p) in enumerate(pairs)], "track_id long, seq int, at_ms long, pos int")


def chapters(spark, *spans):
    return spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "track_id long, chapter_idx int, at_ms long, end_ms long")


def test_velocity_and_rate(spark):
    assert stats.velocities(actions(spark, [(0, 0), (500, 100), (500, 40)])).collect()[0].velocity == 200.0
    m = stats.motion_stats(actions(spark, [(i * 500, 50) for i in range(5)])).first()
    assert (m.rate, m.avg_velocity, m.duration_ms) == (2.5, 0.0, 2000)
    one = stats.motion_stats(actions(spark, [(7, 50)])).first()
    assert (one.n, one.rate, one.avg_stroke, one.p90_velocity) == (1, 0.0, 0.0, 0.0)


def test_position_shapes(spark):
    rails = stats.position_stats(actions(spark, [(i * 100, 100 * (i % 2)) for i in range(100)])).first()
    assert rails.bimodal and rails.rails_pct > 90 and rails.mid_pct == 0 and rails.iqr == 100
    bell = stats.position_stats(actions(spark, [(i * 100, 40 + 20 * (i % 2)) for i in range(100)])).first()
    assert not bell.bimodal and bell.rails_pct == 0 and bell.mid_pct > 90
    d = stats.decile_histogram(actions(spark, [(0, 100), (1, 0), (2, 99), (3, 10)])).first()
    assert (d.d0, d.d1, d.d9) == (1, 1, 2)


def test_speed_and_profile(spark):
    slow = stats.speed_distribution(actions(spark, [(i * 500, 40 + 20 * (i % 2)) for i in range(50)])).first()
    assert slow.very_slow == slow.n == 49
    assert stats.speed_distribution(actions(spark, [(i * 100, 100 * (i % 2)) for i in range(50)])).first().flash == 49
    p = stats.windowed_profile(actions(spark, [(i * 100, 50) for i in range(120)]), 6).orderBy("window").collect()
    assert len(p) == 6 and sum(r.n for r in p) == 119  # the last action lies beyond the last window
    assert stats.windowed_profile(actions(spark, [(0, 1)])).count() == 0


def plain_profile(pairs, n):
    t0, width = pairs[0][0], max(1, (pairs[-1][0] - pairs[0][0]) // n)
    out = []
    for w in range(n):
        seg = [(t, p) for t, p in pairs if t0 + w * width <= t < t0 + (w + 1) * width]
        out.append((len(seg), sum(p for _, p in seg) / len(seg) if len(seg) > 1 else 0.0, sum(abs(a[1] - b[1]) for a, b in zip(seg, seg[1:])) / (len(seg) - 1) if len(seg) > 1 else 0.0))
    return out


def test_profile_against_plain_python(spark):
    rng = random.Random(4)
    at = sorted(rng.randrange(20_000) for _ in range(90))
    pairs = [(t, rng.randrange(101)) for t in at]
    got = [(r.n, r.mean_pos, r.avg_stroke) for r in stats.windowed_profile(actions(spark, pairs)).orderBy("window").collect()]
    for a, b in zip(got, plain_profile(pairs, 12)):
        assert a == pytest.approx(b)


def test_stanzas(spark):
    s = timeline.stanzas(beats(spark, range(0, 17_000, 1000))).orderBy("stanza_idx").collect()
    assert [(r.start_ms, r.end_ms) for r in s] == [(0, 16_000), (16_000, 16_000)]
    a = timeline.action_stanzas(actions(spark, [(i * 100, 0) for i in range(40)])).orderBy("stanza_idx").collect()
    assert [r.start_ms for r in a] == [0, 1600, 3200]
    a = timeline.action_stanzas(actions(spark, [(i * 100, 0) for i in range(20)])).orderBy("stanza_idx").collect()
    assert a[-1].end_ms == 1901


@pytest.mark.parametrize("duration,spans", [(5000, [(0, 5000)]), (30_000, [(0, 15_000), (15_000, 30_000)]), (32_000, [(0, 15_000), (15_000, 32_000)]), (40_000, [(0, 15_000), (15_000, 30_000), (30_000, 40_000)]), (0, [(0, 0)])])
def test_time_chunks(spark, duration, spans):
    got = timeline.time_chunks(spark.createDataFrame([(1, duration)], "track_id long, duration_ms long")).orderBy("chunk_idx").collect()
    assert [(r.at_ms, r.end_ms) for r in got] == spans


def test_nearest_beat(spark):
    b = beats(spark, [100, 200, 300])
    probes = spark.createDataFrame([(1, i, t) for i, t in enumerate([50, 100, 150, 260, 900])], "track_id long, probe_id long, at_ms long")
    found = lambda d: [r.beat_ms for r in timeline.nearest_beat(probes, b, d).orderBy("probe_id").collect()]
    assert found("before") == [100, 100, 100, 200, 300]
    assert found("after") == [100, 200, 200, 300, 300]
    assert found("nearest") == [100, 100, 100, 300, 300]
    with pytest.raises(ValueError):
        timeline.nearest_beat(probes, b, "sideways")
    assert timeline.nearest_beat(probes, b.limit(0), "before").first().beat_ms is None


def test_snap_and_cuts(spark):
    snap = lambda at, centres, r: timeline.snap_within(spark.createDataFrame([(1, at)], "track_id long, at double"), spark.createDataFrame([(1, float(c)) for c in centres], "track_id long, centre double"), r).first().snapped
    assert (snap(10.5, [10, 30], 2), snap(10.5, [50], 2), snap(20.0, [10, 30], 50)) == (10.0, 10.5, 10.0)
    cuts = lambda c: spark.createDataFrame([(1, float(x)) for x in c], "track_id long, cut double")
    got = lambda df: sorted(r.cut for r in df.collect())
    assert got(structure.merge_micro(cuts([0, 100, 110, 300]), 30)) == [0, 100, 300]
    assert got(structure.merge_micro(cuts([0, 100, 295, 300]), 30)) == [0, 100, 300]
    assert got(structure.merge_micro(cuts([0, 5]), 30)) == [0, 5]
    assert got(structure.enforce_max(cuts([0, 100]), 40)) == pytest.approx([0, 100 / 3, 200 / 3, 100])
    assert got(structure.enforce_max(cuts([0, 100]), 0)) == [0, 100]


def test_chapter_index_falls_back_to_the_last(spark):
    spans = spark.createDataFrame([(1, i, t, t) for i, t in enumerate([500, 1000, 99_999])], "track_id long, stanza_idx int, start_ms long, end_ms long")
    ch = chapters(spark, (0, 1000), (1000, 2000), (2000, 3000))
    assert [r.chapter_idx for r in modes.chapter_of(spans, ch).orderBy("stanza_idx").collect()] == [0, 1, 2]


def test_octaves(spark):
    b = beats(spark, [i * 250 for i in range(8)], [0.9, 0.1] * 4)
    bpm = lambda x: spark.createDataFrame([(1, x)], "track_id long, bpm double")
    r = tempo.fold_octaves(b, bpm(235.0)).orderBy("seq").collect()
    assert [x.at_ms for x in r] == [0, 500, 1000, 1500] and r[0].bpm == 117.5 and [x.seq for x in r] == [0, 1, 2, 3]
    r = tempo.fold_octaves(beats(spark, [i * 100 for i in range(16)], [0.1, 0.9] * 8), bpm(360.0)).collect()
    assert len(r) == 4 and r[0].bpm == 90.0
    assert tempo.fold_octaves(b, bpm(160.0)).count() == 8
    ref = lambda x, y: spark.createDataFrame([(1, x, y)], "track_id long, bpm double, ref_bpm double")
    r = tempo.lift_halves(beats(spark, [i * 923 for i in range(8)], [0.2, 0.6] * 4), ref(65.0, 129.2)).orderBy("seq").collect()
    assert len(r) == 15 and r[0].bpm == 130.0 and r[1].energy == pytest.approx(0.4) and r[1].at_ms == 461
    assert tempo.lift_halves(beats(spark, [0, 465, 930, 1395, 2325, 3255]), ref(64.5, 129.0)).count() == 8
    assert tempo.lift_halves(beats(spark, [0, 900, 1800, 2700]), ref(65.0, 90.0)).count() == 4


def plain_modes(b, spans):
    """Whole-track modes, from their definition."""
    es = sorted(e for _, e in b)
    rank = lambda s, q: s[min(len(s) - 1, int(len(s) * q))] if s else 0.0
    rows = []
    for s, e in spans:
        x = [en for t, en in b if s <= t < e]
        rows.append((x, len(x) / max(1e-6, (e - s) / 1000)))
    med = rank(sorted(d for x, d in rows if x), 0.5)
    out = []
    for x, d in rows:
        if not x:
            out.append("break")
            continue
        avg, mid = sum(x) / len(x), len(x) // 2
        second = sum(x[mid:]) / (len(x) - mid) if mid else x[0]
        trend = second - sum(x[:mid]) / mid if mid else 0.0
        out.append("break" if avg < max(rank(es, 0.15), 0.08) else "edging" if trend >= 0.15 and second >= rank(es, 0.5) else "fast" if med > 0 and d >= 1.25 * med else "slow" if med > 0 and d <= 0.75 * med else "tease" if avg < rank(es, 0.4) else "steady")
    return out


def test_modes_whole_against_plain_python(spark):
    rng = random.Random(9)
    seen = set()
    for _ in range(6):
        at, t = [], 0
        for k in range(150):
            t += rng.choice([200, 400, 400, 400, 900]) if k // 16 % 3 else rng.choice([150, 250])
            at.append(t)
        e = [round(min(1, max(0, rng.gauss(0.5, 0.1) + (0.3 * (k % 16) / 16 if k // 16 % 2 else 0) - (0.45 if k // 16 == 4 else 0))) * 1024) / 1024 for k in range(150)]
        df = beats(spark, at, e)
        s = timeline.stanzas(df)
        spans = [(r.start_ms, r.end_ms) for r in s.orderBy("stanza_idx").collect()]
        got = [r["mode"] for r in modes.modes_whole(df, s).orderBy("stanza_idx").collect()]
        assert got == plain_modes(list(zip(at, e)), spans)
        seen |= set(got)
    assert {"steady", "edging", "break", "fast"} <= seen


def test_modes_per_chapter(spark):
    spans = lambda *s: spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(s)], "track_id long, stanza_idx int, start_ms long, end_ms long")
    mode = lambda b, s, c: [r["mode"] for r in modes.modes_per_chapter(b, s, c).orderBy("stanza_idx").collect()]
    at = list(range(0, 8000, 600))
    assert mode(beats(spark, at, 0.2), spans((0, 8000)), chapters(spark, (0, 8000))) == ["steady"]
    assert mode(beats(spark, at, 0.02), spans((0, 8000)), chapters(spark, (0, 8000))) == ["break"]
    assert mode(beats(spark, at, [0.3] * 7 + [0.7] * 7), spans((0, 8000)), chapters(spark, (0, 8000))) == ["edging"]
    assert mode(beats(spark, at, 0.5), spans((9000, 9500)), chapters(spark, (8500, 10_000))) == ["break"]


def test_action_modes(spark):
    mode = lambda pairs: modes.action_modes(actions(spark, pairs), timeline.action_stanzas(actions(spark, pairs))).first()["mode"]
    assert mode([(0, 50)]) == "break"
    assert mode([(i * 500, 50 + i % 2) for i in range(10)]) == "break"
    assert mode([(i * 200, 100 * (i % 2)) for i in range(16)]) == "fast"
    assert mode([(i * 2000, 100 * (i % 2)) for i in range(10)]) == "slow"
    assert mode([(i * 500, 50 + (5 if i < 8 else 40) * (i % 2)) for i in range(16)]) == "edging"
    assert mode([(i * 500, 50 + 20 * (i % 2)) for i in range(10)]) == "tease"


def test_arc(spark):
    p = [0.0, 0.3, 0.4, 0.5, 0.85, 1.0]
    got = [r.arc for r in spark.createDataFrame([(float(x),) for x in p], "p double").select(curve.arc_curve(F.col("p")).alias("arc")).collect()]
    assert got == pytest.approx([0.0, 0.5, 0.5, 0.5, 0.72, 0.0])
    n = [r.n for r in spark.createDataFrame([(x / 100,) for x in range(101)], "a double").select(curve.arc_strokes(F.col("a")).alias("n")).collect()]
    assert n[0] == n[45] == 2 and n[100] == 6 and all(x % 2 == 0 for x in n) and n == sorted(n)
    levels = spark.createDataFrame([(1, 0, 0, 1000, 0.9), (1, 1, 0, 2000, 0.1)], "track_id long, span_idx int, start_ms long, end_ms long, level double")
    assert [r.arc for r in curve.density_arc_from_levels(beats(spark, [100, 600, 2100]), levels, 0.3).orderBy("seq").collect()] == [0.9, 0.9, 0.3]
    assert curve.fired(beats(spark, range(0, 5000, 500)).withColumn("arc", F.lit(0.0))).count() == 0


def test_fire_accumulator_is_the_scan(spark):
    rng = random.Random(1)
    arc = [rng.random() * 0.6 for _ in range(300)]
    df = spark.createDataFrame([(1, i, i, 0.5, a) for i, a in enumerate(arc)], BEATS + ", arc double")
    acc, want = 0.0, []
    for i, a in enumerate(arc):
        acc += min(1.0, a / 0.45)
        if acc >= 1:
            acc -= 1
            want.append(i)
    assert sorted(r.seq for r in curve.fired(df).collect()) == want


def test_curves(spark):
    b = beats(spark, [0, 1000, 2000])
    c = curve.beats_to_curve(b, stroke_density=4).orderBy("at_ms").collect()
    assert len(c) == 12 and [r.at_ms for r in c[:4]] == [0, 250, 500, 750] and {r.pos for r in c} == {0, 100}
    quiet = curve.beats_to_curve(beats(spark, [0, 500], [0.0, 1.0]), depth_model="energy").orderBy("at_ms").collect()
    assert quiet[0].pos == 30 and quiet[1].pos == 10
    assert curve.beats_to_curve(beats(spark, [0], 1.0), depth_model="energy").first().pos == 90
    gained = curve.beats_to_curve(b.withColumn("gain", F.lit(0.5)), gain=True)
    assert gained.agg(F.max("pos")).first()[0] == 75
    ramp = curve.beats_to_curve(beats(spark, range(0, 8000, 500), [0.25 + 0.05 * i for i in range(16)]), texture=0.4).groupBy("seq").agg(F.max("pos").alias("p")).orderBy("seq").collect()
    assert ramp[-1].p == 100 and 80 <= ramp[0].p < 100
    with pytest.raises(ValueError):
        curve.resolve_density("3")
    out = curve.export_points(spark.createDataFrame([(1, 0, 90), (1, 0, 50), (1, 500, 10), (1, 700, 140)], "track_id long, at_ms long, pos int")).orderBy("at_ms").collect()
    assert [(r.at_ms, r.pos) for r in out] == [(0, 50), (500, 10), (700, 100)]


def test_generate_per_chapter_keeps_each_chapters_beats(spark):
    b = beats(spark, range(0, 60_000, 500), [0.2] * 60 + [0.9] * 60)
    recipes = spark.createDataFrame([(1, 0, 0), (1, 1, 1)], "track_id long, chapter_idx int, recipe int")
    ch = chapters(spark, (0, 30_000), (30_000, None))
    got = curve.generate_per_chapter(b, ch, [{}, {"stroke_density": 8}], recipes)
    n = {r.chapter_idx: r.n for r in got.groupBy("chapter_idx").agg(F.count("*").alias("n")).collect()}
    assert n[1] > 3 * n[0] > 0
    assert got.where("chapter_idx = 0").agg(F.max("at_ms")).first()[0] < 30_500
    for wrong in (recipes.where("chapter_idx = 0"), recipes.union(spark.createDataFrame([(1, 2, 0)], recipes.schema))):
        with pytest.raises(Exception, match="differ in number"):
            curve.pair_recipes(ch, wrong).collect()
    with pytest.raises(ValueError):
        curve.generate_per_chapter(b, ch, [{}])


def test_spans_that_do_not_overlap(spark):
    """The window form gives what the join gives, with ties, empty spans, points outside and other tracks."""
    rng = random.Random(6)
    points = [(t, i, rng.randrange(-5, 60)) for t in (1, 2, 3) for i in range(40)]
    spans = [(t, k, a, b) for t in (1, 2) for k, (a, b) in enumerate([(0, 7), (7, 7), (7, 20), (25, 40), (40, None) if t == 1 else (40, 45)])]
    p = spark.createDataFrame([(*x, x[1]) for x in points], "track_id long, point_id int, at_ms long, seq int")
    s = spark.createDataFrame([(*x, f"s{x[1]}") for x in spans], "track_id long, span_idx int, start_ms long, end_ms long, name string")
    for last in (False, True):
        a, b = (sorted(map(str, f(p, s, F.col("at_ms"), ["name"], last=last).collect())) for f in (timeline.containing, timeline.tiled))
        assert a == b


def test_fired_passes_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(2)
    rows = [(t, i, i * 10, rng.choice([0.0, 0.1, 0.3, 0.44, 0.45, 0.9])) for t in range(5) for i in range(60)]
    want = []
    for t in range(5):
        acc = 0.0
        for _, i, _, arc in (r for r in rows if r[0] == t):
            acc += min(1.0, arc / 0.45)
            if acc >= 1:
                acc -= 1
                want.append((t, i))
    df = spark.createDataFrame(rows, "track_id long, seq int, at_ms long, arc double").repartition(3, "at_ms")
    assert sorted((r.track_id, r.seq) for r in curve.fired(df).collect()) == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_octaves_fold_to_the_end(spark):
    b = beats(spark, range(0, 4096), [0.5] * 4096)
    r = tempo.fold_octaves(b, spark.createDataFrame([(1, 60_000.0)], "track_id long, bpm double")).collect()
    assert {x.bpm for x in r} == {60_000 / 2**9} and len(r) == 8


def test_scenes(spark):
    cuts = spark.createDataFrame([(1, 100), (1, 234), (3, 0)], "track_id long, frame_idx int")
    tracks = spark.createDataFrame([(1, 300), (2, 48), (3, 24), (4, 0)], "track_id long, n_frames long")
    got = [tuple(r) for r in structure.scenes(cuts, tracks, 24.0).orderBy("track_id", "index").collect()]
    assert got == [(1, 1, 0, 4167, 4167), (1, 2, 4167, 9750, 5583), (1, 3, 9750, 12_500, 2750), (2, 1, 0, 2000, 2000), (3, 1, 0, 1000, 1000)]


def test_direct_play(spark):
    import json

    good = {"codec_type": "video", "codec_name": "h264", "pix_fmt": "yuv420p", "profile": "High", "width": 2560, "color_transfer": "bt709", "avg_frame_rate": "30000/1001", "r_frame_rate": "30/1"}
    changes = [({}, True), ({"codec_name": "H264"}, True), ({"codec_name": "hevc"}, False), ({"codec_name": None}, False), ({"pix_fmt": None}, True), ({"pix_fmt": "yuv420p10le"}, False), ({"profile": "High 10"}, False), ({"profile": "High 4:2:2 (422)"}, False),
               ({"width": 2561}, False), ({"width": None}, True), ({"color_transfer": "SMPTE2084"}, False), ({"color_transfer": "arib-std-b67"}, False), ({"color_primaries": "bt2020"}, False), ({"avg_frame_rate": "29.6"}, False), ({"avg_frame_rate": "29.71"}, True), ({"avg_frame_rate": "0/0"}, False), ({"r_frame_rate": "x"}, False), ({"r_frame_rate": None}, False)]
    sound = {"codec_type": "audio", "codec_name": "aac"}
    rows = [(i, json.dumps({"streams": [sound, {**good, **c}, {**good, "codec_name": "mjpeg"}]})) for i, (c, _) in enumerate(changes)]
    rows += [(100, json.dumps({"streams": [sound]})), (101, "{}"), (102, rows[0][1][:40]), (103, None), (104, "")]
    got = {r.media_id: r.direct for r in shell.direct_play(spark.createDataFrame(rows, "media_id long, probe string").select("media_id", shell.first_video(F.col("probe")).alias("video"))).collect()}
    assert got == {**{i: ok for i, (_, ok) in enumerate(changes)}, **dict.fromkeys(range(100, 105), False)}


def test_clips_and_paths(spark):
    names = {"/a/b/My Film!.MKV": "/a/b/.My Film!.forge/clips/My_Film_v13_5_90.mkv", "track": ".track.forge/clips/track_v13_5_90.mp4", "/x/.hidden": "/x/..hidden.forge/clips/hidden_v13_5_90.mp4", "/x/???.mp4": "/x/.???.forge/clips/media_v13_5_90.mp4", "a.b.webm": ".a.b.forge/clips/a.b_v13_5_90.webm", "/x/end.": "/x/.end..forge/clips/end_v13_5_90.mp4"}
    media = spark.createDataFrame([(i, p, w) for i, (p, w) in enumerate(zip(names, [1920, 1921, None, 3840, 0, 640]))], "media_id int, path string, width int")
    ch = spark.createDataFrame([(i, k, a, b) for i in range(6) for k, (a, b) in enumerate([(5, 90), (90, None), (90, 90)])], "media_id int, chapter_idx int, at_ms long, end_ms long")
    plan = shell.clip_plan(media, ch, spark.createDataFrame([(names["track"],), (names["track"],)], "path string"))
    got = sorted(tuple(r) for r in plan.collect())
    assert [(r[2], r[3], r[4]) for r in got if r[1] == 0] == [(c, "720p" if i in (1, 3) else "source", "cached" if i == 1 else "build") for i, c in enumerate(names.values())]
    assert len(got) == 12 and all(r[4] == "rejected" for r in got if r[1] == 2)
    summary = {r.media_id: r.summary for r in shell.clip_batch(plan, plan.where("media_id = 3").select("clip")).collect()}
    assert (summary[0], summary[1], summary[3]) == ("1/1 clips ready (0 cached, 1 built)", "1/1 clips ready (1 cached, 0 built)", "0/1 clips ready (0 cached, 0 built)")
    side = media.select(shell.sidecar_path(F.col("path"), "chapters").alias("p")).collect()
    assert side[0].p == "/a/b/.My Film!.forge/My Film!.chapters.json"
    with pytest.raises(ValueError):
        shell.sidecar_path(F.col("path"), "pictures")


def test_cache(spark):
    import hashlib

    key = hashlib.sha256(b"/m/a.mp4|123456789|42|22050|1").hexdigest()[:16]
    files = spark.createDataFrame([(1, "/m/a.mp4", 123456789, 42), (2, "/m/b.mp4", None, None), (3, "/m/c.mp4", 1, 1)], "media_id int, path string, mtime_ns long, size long")
    slot = f"/tmp/x/fa-{key}.wav"
    look = lambda length, meta: {r.media_id: (r.hit, r.load_path, r.damaged_after_ms) for r in shell.cache_lookup(files, spark.createDataFrame([(slot, length, meta)], "path string, length long, meta string"), folder="/tmp/x/").collect()}
    missed = (False, None, None)
    assert look(9, '{"damaged_after_ms": 77}') == {1: (True, slot, 77), 2: missed, 3: missed}
    assert look(9, "{broken")[1] == look(9, None)[1] == (True, slot, None) and look(0, None)[1] == missed
    assert look(9, None) != {} and spark.range(1).select(shell.cache_key(F.lit("/m/a.mp4"), F.lit(1), F.lit(2), 16000).alias("k")).first().k != key


def test_energy_per_chapter(spark):
    ch = chapters(spark, (0, 2000), (2000, None), (90_000, 99_000))
    got = {r.chapter_idx: r for r in tempo.energy_per_chapter(beats(spark, range(0, 4000, 500), [0, 0.5, 1, 0.5, 0.1, 0.2, 0.3, 0.4]), ch).collect()}
    assert set(got) == {0, 1} and got[0].p50 == 0.5 and got[0].bpm == 120.0


def test_documents(spark):
    schema = "track_id long, seq int, at_ms long, end_ms long, name string, intent string"
    rows = [(1, 0, 0, None, "Intro", ""), (1, 1, 83_000, None, "", "Topic 1"), (1, 2, 300_000, None, None, None), (2, 0, 0, None, "a", ""), (3, 0, 5, None, "a", ""), (3, 1, 50_000, None, "b", ""), (3, 2, 90_000, None, "c", ""), (4, 0, 0, None, "a", ""), (4, 1, 5000, None, "b", ""), (4, 2, 3_600_000, None, "c", "")]
    got = {r.track_id: r for r in documents.youtube_block(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].block == "0:00 Intro\n1:23 Topic 1\n5:00 Chapter 3\n"
    assert [got[i].error for i in (2, 3, 4)] == ["fewer than 3 chapters", "first chapter not at 0", "chapter under 10 s"]
    meta = documents.ffmetadata(spark.createDataFrame([(1, 0, 0, None, "A=B;C#D\\", ""), (1, 1, 700, 600, "", "")], schema)).first().text
    assert meta == ";FFMETADATA1\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=700\ntitle=A\\=B\\;C\\#D\\\\\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=700\nEND=701\n"
    bad = documents.parse_events(spark.createDataFrame([(1, 0, '{"type":"x","at_ms":5}'), (1, 1, '{"at_ms":5}'), (1, 2, "no json")], "track_id long, seq int, doc string")).orderBy("seq").collect()
    assert [r.rejected for r in bad] == [False, True, True] and bad[0].confidence == 1.0


MERGES = [
    ("analyze", {"auto_generated": "false", "name": "mine", "tone": "rise"}, {"name": "x", "tone": "fall", "confidence": "1"}, {"auto_generated": "false", "name": "mine", "tone": "rise"}),
    ("analyze", {"name": "mine", "tone": "rise", "end_ms": "9"}, {"name": "x", "tone": "fall", "confidence": "1", "end_ms": "5", "vendor": "v"}, {"name": "mine", "tone": "fall", "end_ms": "9", "confidence": "1", "vendor": "v"}),
    ("analyze", {"confidence": "1", "vendor": "old"}, {"vendor": "new", "auto_generated": "true"}, {"confidence": "1", "vendor": "old", "auto_generated": "true"}),
    ("edit", {"name": "a"}, {"name": "b", "confidence": "2"}, {"name": "b", "confidence": "2", "auto_generated": "false"}),
    ("edit", {"auto_generated": "false", "name": "a"}, {"name": "b"}, {"auto_generated": "false", "name": "a"}),
    ("edit", {"name": "a", "auto_generated": "true"}, {"auto_generated": "true"}, {"name": "a", "auto_generated": "true"}),
]


@pytest.mark.parametrize("mode,old,new,want", MERGES)
def test_merge(spark, mode, old, new, want):
    schema = "track_id long, ord int, fields map<string,string>"
    e = spark.createDataFrame([(1, 0, {"at_ms": "0", **old}), (1, 1, {"at_ms": "5", "name": "kept"}), (1, 2, {"at_ms": "0", "name": "later double"})], schema)
    i = spark.createDataFrame([(1, 0, {"at_ms": "0", **new}), (1, 1, {"at_ms": "7"}), (1, 2, {"at_ms": "7"}), (1, 3, {"at_ms": "0", "name": "second match"})], schema)
    got = [r.fields for r in merge.merge_records(e, i, merge.CHAPTER, mode).orderBy("ord").collect()]
    assert got == [{"at_ms": "0", **want}, {"at_ms": "5", "name": "kept"}, {"at_ms": "7"}, {"at_ms": "7"}]


def test_validation_and_shell(spark):
    r = spark.createDataFrame([(1, 0, {"mode": "fast"}), (1, 1, {"mode": "wild"}), (1, 2, {"content_type": "loud"}), (1, 3, {})], "track_id long, ord int, fields map<string,string>")
    assert sorted(x.ord for x in merge.invalid_records(r).collect()) == [1, 2]
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    assert value(shell.sanitised(F.lit("..a b/c é.mp4.."))) == "a_b_c_.mp4"
    assert value(shell.sanitised(F.lit("???"))) == "media"
    assert value(shell.frame_rate(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01) and value(shell.frame_rate(F.lit("x"))) is None
    assert value(shell.progress_us(F.lit("out_time_us=123"))) == 123 and value(shell.progress_us(F.lit("speed=2x"))) is None
    assert value(shell.salvage_to(F.lit(1), F.lit(60_000_000))) == 52.0 and value(shell.salvage_to(F.lit(0), F.lit(60_000_000))) is None
    assert value(shell.coverage_shortfall(F.lit(90_000), F.lit(100_000))) and value(shell.coverage_shortfall(F.lit(99_000), F.lit(100_000))) is None
    assert value(documents.timestamp_text(F.lit(-5))) == "0:00" and value(documents.timestamp_text(F.lit(3_661_000))) == "1:01:01"
    assert value(shell.eta(F.lit(None).cast("double"), F.lit(0.25), F.lit(10.0))) == 30.0 and value(shell.eta(F.lit(8.0), F.lit(0.25), F.lit(10.0))) == 6.0
    cat = shell.patterns(spark)
    assert cat.select("id").distinct().count() == 8 and value(shell.is_pattern(F.lit("_none")))
