"""A recording of over ten minutes, read in chunks: what depends on its length takes the whole."""

import json

import numpy as np

from chronoloom import cli
from chronoloom.dsp import plans
from tests.test_dsp import SR, clicks, sine, wav_bytes


def test_long_recording(spark, tmp_path, capsys):
    y = np.concatenate([clicks(120, 330), sine(330)])
    (tmp_path / "long.wav").write_bytes(wav_bytes(y))
    samples = plans.read_samples(spark.read.format("binaryFile").load(str(tmp_path))).persist()
    assert {round(r.track_s) for r in samples.collect()} == {660} and samples.count() == 4

    at = lambda tracker: sorted(r.at_ms for r in plans.beats(samples, tracker=tracker).collect())
    assert at("auto") == at("plp") != at("beat")
    cuts = plans.track_segments(samples).collect()
    assert len(cuts) == 1 and abs(cuts[0]["at"] - 330) < 3

    assert cli.main(["auto-chapter", str(tmp_path)]) == 0
    run = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert len(run["chapters"]) == 2 and run["chapters"][0]["at_ms"] == 0 and run["chapters"][-1]["end_ms"] == 660_000
    assert run["beats"] and run["stanzas"] and run["energy"]
