"""Documents: spellings, forms, bundles, top-level merge."""

import base64
import json

from chronoloom.operators import merge
from chronoloom.sources import timeline

DOC = "track_id long, doc string"


def test_chapter_forms(spark):
    docs = [(1, json.dumps({"chapters": [{"at_ms": 5, "name": "a", "content_type": "music", "tone": "none"}]})), (2, json.dumps([{"start_ms": 7, "intent_proposal": "p"}, {"at": 9, "intent": "i"}, {"name": "no time"}])), (3, "not json"), (4, None), (5, "{}")]
    got = {(r.track_id, r.at_ms): r for r in timeline.document_chapters(spark.createDataFrame(docs, DOC)).collect()}
    assert set(got) == {(1, 5), (2, 7), (2, 9)}
    assert got[1, 5].content_type == "driving" and got[1, 5].tone == "" and got[2, 7].intent == "p" and got[2, 9].intent == "i"


def test_analysis_prefers_confirmed(spark):
    docs = [(1, json.dumps({"metadata": {"chapters": [{"at_ms": 1}]}, "chapter_proposals": [{"start_ms": 2}]})), (2, json.dumps({"metadata": {"chapters": []}, "chapter_proposals": [{"start_ms": 2}]})), (3, json.dumps({"chapter_proposals": [{"start_ms": 3}]}))]
    assert sorted((r.track_id, r.at_ms) for r in timeline.analysis_chapters(spark.createDataFrame(docs, DOC)).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_probe_and_resolver(spark):
    probe = json.dumps({"chapters": [{"start_time": "0.0005", "end_time": "1.5", "tags": {"title": "x"}}, {"start_time": "bad"}]})
    (r,) = timeline.probe_chapters(spark.createDataFrame([(1, probe)], "track_id long, probe string")).collect()
    assert (r.at_ms, r.end_ms, r.name) == (0, 1500, "x")  # halves to even
    rows = [(1, 0, "sidecar", None), (1, 1, "mp4", []), (1, 2, "analysis", [3]), (2, 0, "sidecar", [1]), (2, 1, "mp4", [2])]
    got = {x.track_id: (x.source, x.chapters) for x in timeline.resolve_chapters(spark.createDataFrame(rows, "track_id long, priority int, source string, chapters array<long>")).collect()}
    assert got == {1: ("mp4", []), 2: ("sidecar", [1])}


def test_bundles_and_beat_maps(spark, tmp_path):
    doc = json.dumps({"chapters": [{"at_ms": 0, "end_ms": 5}, {"at_ms": 5}], "recipes": [{"source": "full", "tone": "rise"}, {"source": "full"}]})
    got = timeline.recipe_bundles(spark.createDataFrame([(1, doc), (2, json.dumps({"chapters": [{"at_ms": 0}], "recipes": []}))], DOC)).collect()
    assert [(r.chapter_idx, r.tone, r.mismatched) for r in got if r.track_id == 1] == [(0, "rise", False), (1, None, False)]
    assert all(r.mismatched for r in got if r.track_id == 2)
    (tmp_path / "m.json").write_text(json.dumps({"bpm": 120, "duration_ms": 999, "beats": [0, 500], "energy": [0.1, 0.2]}))
    assert [(r.seq, r.at_ms, r.energy) for r in timeline.read_beat_maps(spark, str(tmp_path)).collect()] == [(0, 0, 0.1), (1, 500, 0.2)]
    odd = timeline.parse_chapters(spark.createDataFrame([(1, None, 4, None, None, "", "p"), (1, None, None, None, 9, "x", None)], "track_id long, at_ms long, start_ms long, at long, end_ms long, intent string, intent_proposal string")).collect()
    assert [(r.at_ms, r.intent, r.rejected) for r in odd] == [(4, "p", False), (None, "x", True)]
    m = timeline.mono(spark.createDataFrame([([1.0, 3.0, 5.0, 7.0],), ([],)], "data array<double>"), 2).collect()
    assert [r.data for r in m] == [[2.0, 6.0], []]


def test_document_merge(spark):
    old = [(1, None, None, None, False, "me", '{"p":1}', {"x": "1", "y": "1"}), (2, "s", "2.0", None, True, None, None, None)]
    new = [(1, None, None, None, None, "you", None, {"y": "2"}), (3, None, None, None, None, "you", '{"p":3}', None)]
    e, i = spark.createDataFrame(old, merge.DOCUMENT), spark.createDataFrame(new, merge.DOCUMENT)
    got = {r.track_id: r for r in merge.merge_documents(e, i, "edit").collect()}
    assert (got[1].version, got[1].auto_generated, got[1].generated_by, got[1].energy, got[1].extras, got[1].analyzer_version) == ("3.0", False, "me", '{"p":1}', {"x": "1", "y": "2"}, None)
    assert (got[2].version, got[2].auto_generated) == ("2.0", True)
    assert (got[3].auto_generated, got[3].generated_by) == (True, "you")
    assert {r.track_id: r.analyzer_version for r in merge.merge_documents(e, i, "analyze").collect()} == {1: "1", 2: None, 3: "1"}
    records = spark.createDataFrame([(1, 0, {"tone": "none"}), (1, 1, {"auto_generated": "true"}), (2, 0, {"tone": "rise"})], "track_id long, ord int, fields map<string,string>")
    got = [r.fields for r in merge.normalise_records(records, e).orderBy("track_id", "ord").collect()]
    assert got == [{"tone": "", "auto_generated": "false"}, {"auto_generated": "true"}, {"tone": "rise"}]
    touched = spark.createDataFrame([(1, 0, '{"a":1}'), (0, 2, "{}")], "n_chapters int, n_stanzas int, energy string").select(merge.fields_touched().alias("f")).collect()
    assert [r.f for r in touched] == [["chapters", "energy"], ["stanzas"]]


def test_sinks_and_loading(spark, tmp_path):
    from pyspark.sql import functions as F

    from chronoloom.sources import sinks

    beats = spark.createDataFrame([(1, i, i * 500, 0.12345678) for i in range(5)], "track_id long, seq int, at_ms long, energy double")
    tracks = spark.createDataFrame([(1, 120.0, 2500, None)], "track_id long, bpm double, duration_ms long, damaged_after_ms long")
    doc = json.loads(sinks.beat_maps(beats, tracks).first().doc)
    assert doc == {"bpm": 120.0, "duration_ms": 2500, "beats": [0, 500, 1000, 1500, 2000], "downbeats": [0, 2000], "energy": [0.123457] * 5}
    ch = spark.createDataFrame([(5, None, "", "x", "", "", None, [])], "at_ms long, end_ms long, name string, intent string, content_type string, tone string, confidence double, evidence array<string>")
    assert json.loads(ch.select(sinks.chapter_text().alias("d")).first().d) == {"at_ms": 5, "intent": "x"}
    peaks = spark.createDataFrame([(1, 1, 10.0, [0.5]), (1, 0, 10.0, [0.1, 1.0])], "track_id long, chunk_idx int, hop_ms double, peaks array<double>")
    assert json.loads(sinks.peak_documents(peaks).first().doc)["peaks"] == [0.1, 1.0, 0.5]
    docs = spark.createDataFrame([(1, '{"version":"1.1"}', 1), (1, '{"version":"1.1","x":1}', 2), (2, '{"version":"1.0"}', 9)], "track_id long, doc string, written_at int")
    assert [(r.track_id, r.written_at) for r in sinks.latest(docs, "1.1").collect()] == [(1, 2)]
    sinks.write_json_atomic(str(tmp_path / "a.json"), {"version": "1.1", "n": 1}, None)
    (tmp_path / "b.json").write_text("{broken")
    assert [r.n for r in timeline.load_documents(spark, str(tmp_path), "version string, n int").collect()] == [1]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json", "b.json"]
    s = timeline.parse_stanzas(spark.createDataFrame([('{"chapter_idx":0,"at_ms":1,"end_ms":2,"mode":"fast"}', 1), ("{}", 2)], "doc string, track_id long")).orderBy("track_id").collect()
    assert [(r.rejected, r.auto_generated) for r in s] == [(False, True), (True, True)]
    d = timeline.probe_dimensions(spark.createDataFrame([("  Stream #0: Video: h264 (High), yuv420p, 1920x1080 [SAR 1:1], 25 fps",), ("Audio: aac",)], "line string")).collect()
    assert [(r.width, r.height) for r in d] == [(1920, 1080), (None, None)]
    one = spark.range(1).select(sinks.omit(F.lit(True), True).alias("a"), sinks.omit(F.lit(False), True).alias("b")).first()
    assert (one.a, one.b) == (None, False)


def test_reporter_pairs_events_and_learns(tmp_path):
    from chronoloom.streaming.reporter import Durations, Reporter, append_to

    now, events = [0.0], []
    log = tmp_path / "log.jsonl"

    def broken(_):
        raise OSError

    known = Durations(str(tmp_path / "d.json"))
    r = Reporter(broken, events.append, append_to(str(log)), durations=known, clock=lambda: now[0])
    r.progress(0.5)  # outside every stage: nothing
    try:
        with r.stage("run"):
            now[0] = 1.0
            with r.stage("load"):
                now[0] = 5.0
                r.progress(1.5 / 2, "three quarters")
                r.message("still here")
                r.summary("done")
            raise KeyError
    except KeyError:
        pass
    kinds = [(e["kind"], "/".join(e["stage_path"]), e["progress"], e["elapsed_s"], e["eta_s"]) for e in events]
    assert kinds == [("start", "run", None, None, None), ("start", "run/load", None, None, None), ("progress", "run/load", 0.75, 4.0, 4.0 / 3), ("progress", "run/load", None, None, None), ("complete", "run/load", None, 4.0, None), ("complete", "run", None, 5.0, None)]
    assert events[4]["summary"] == "done" and events[5]["summary"] is None and events[3]["message"] == "still here"
    assert len(log.read_text().splitlines()) == 6
    known.save()
    again = Durations(str(tmp_path / "d.json"))
    assert again.left("run/load") == 4.0 and again.left("run/load", 0.5) == 2.0
    again.learn("run/load", 14.0)
    assert abs(again.left("run/load") - 7.0) < 1e-9
    (tmp_path / "d.json").write_text("{broken")
    assert Durations(str(tmp_path / "d.json")).left("run") is None


def test_publish_never_fails_a_run(tmp_path):
    from chronoloom.sources import sinks

    staged, slot = tmp_path / "x.wav", tmp_path / "fa-1.wav"
    staged.write_bytes(b"abc")
    assert sinks.publish(str(staged), str(slot), {"damaged_after_ms": None}) == str(slot)
    assert slot.read_bytes() == b"abc" and not staged.exists() and (tmp_path / "fa-1.json").exists()
    assert sinks.owned_by_cache(str(slot), str(tmp_path)) and not sinks.owned_by_cache(str(staged), str(tmp_path)) and not sinks.owned_by_cache(None, str(tmp_path))
    staged.write_bytes(b"abc")
    assert sinks.publish(str(staged), None, {}) == str(staged) == sinks.publish(str(staged), str(tmp_path / "no" / "fa-2.wav"), {})


def test_sidecar_documents(spark):
    """Peaks, spectrograms and stanzas as documents, read again as plain JSON."""
    from chronoloom.sources import sinks

    peaks = spark.createDataFrame([("a", 1, 10.0, [0.5]), ("a", 0, 10.0, [1.0, 0.25]), ("b", 0, 10.0, [])], "track_id string, chunk_idx int, hop_ms double, peaks array<double>")
    got = {r.track_id: json.loads(r.doc) for r in sinks.peak_documents(peaks).collect()}
    assert got["a"]["peaks"] == [1.0, 0.25, 0.5] and (got["a"]["peak_count"], got["a"]["duration_ms"], got["a"]["version"]) == (3, 30, "1.1")
    assert got["b"]["peaks"] == [] and got["b"]["duration_ms"] == 0
    schema = "track_id string, chunk_idx int, n_mels int, n_frames int, hop_us long, hop_ms long, cells binary"
    cells = spark.createDataFrame([("a", 1, 2, 3, 23220, 23, bytearray(range(80, 86))), ("a", 0, 2, 40, 23220, 23, bytearray(range(80)))], schema)
    doc = json.loads(sinks.spectrogram_documents(cells).first().doc)
    assert base64.b64decode(doc["cells_b64"]) == bytes(range(86)) and (doc["hop_us"], doc["n_mels"], doc["n_frames"], doc["duration_ms"], doc["version"]) == (23220, 2, 43, 998, "1.2")
    assert (doc["fmax"], doc["db_floor"], doc["db_ceiling"]) == (8000.0, -80.0, 0.0)
    stanza = spark.createDataFrame([(0, 5, 9, "slow", "", "rise", True), (1, 9, 12, "fast", "x", "", False)], "chapter_idx int, at_ms long, end_ms long, mode string, source string, tone string, auto_generated boolean")
    texts = [json.loads(r.t) for r in stanza.select(sinks.stanza_text().alias("t")).collect()]
    assert texts == [{"chapter_idx": 0, "at_ms": 5, "end_ms": 9, "mode": "slow", "tone": "rise"}, {"chapter_idx": 1, "at_ms": 9, "end_ms": 12, "mode": "fast", "source": "x", "auto_generated": False}]
