"""Every query against its SQL on the smallest tables; streaming; command line."""

import datetime
import json

import duckdb
import pytest

import __spark_entry__
from chronoloom import cli
from chronoloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in ("events", "embeddings", "conversations", "part", "orders", "lineitem"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(c).to_pylist() for c in names])))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equal_to_sql(spark, engine, name):
    assert rows(catalog.QUERIES[name](spark, SF).toArrow()) == rows(engine.sql(catalog.ORACLE_SQL[name]).to_arrow_table())


def test_halves_of_a_millisecond(spark, tmp_path):
    """Times whose millisecond, cut off instead of rounded, lies in another minute of the track, before 1970 too."""
    starts = [datetime.datetime(1969, 12, 31, 23, 40), datetime.datetime(1970, 1, 1), datetime.datetime(2024, 1, 1, 0, 0, 7, 179_000), datetime.datetime(2024, 1, 30)]
    micros = lambda track, i: (-501, -500, -499, -1, 0, 499, 500)[i * 3 % 7] if i else (0, 500)[track % 2]
    events = [(40 * t + i, start + datetime.timedelta(minutes=i, microseconds=micros(t, i)), t, "click", 1.0 + i * 7 % 13, '{"k": 1}') for t, start in enumerate(starts) for i in range(40)]
    own = duckdb.connect()
    own.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    own.executemany("insert into events values (?, ?, ?, ?, ?, ?)", events)
    own.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    for name in ("canonical_beats_", "action_stanzas", "action_modes", "auto_tone", "beat_documents", "chapter_index_at", "curve_energy_legacy"):
        assert rows(catalog.QUERIES[name](spark, str(tmp_path)).toArrow()) == rows(own.sql(catalog.ORACLE_SQL[name]).to_arrow_table()), name


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_columns_and_make_no_nested_loops(spark):
    plan = catalog.QUERIES["velocities"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in ("modes_whole", "shape_curve", "nearest_beat_nearest", "energy_per_chapter"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_streams(spark, tmp_path):
    from chronoloom.streaming import progress

    t0 = datetime.datetime(2026, 1, 1)
    at = lambda s: t0 + datetime.timedelta(seconds=s)
    events = [("complete", ["a", "b"], None, 10.0, at(0)), ("progress", ["a", "b"], 0.5, 3.0, at(1)), ("progress", ["x"], 0.25, 10.0, at(2)), ("complete", ["a", "b"], None, 20.0, at(3)), ("progress", ["a", "b"], 0.0, 0.0, at(4))]
    spark.createDataFrame(events, progress.EVENT).coalesce(1).write.parquet(str(tmp_path / "e"))
    spark.createDataFrame([(1, i, 0.3) for i in range(9)], "track_id long, seq int, arc double").coalesce(1).write.parquet(str(tmp_path / "b"))

    def drain(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.sql(f"select * from {name}").collect()

    stream = spark.readStream.schema(progress.EVENT).parquet(str(tmp_path / "e"))
    got = {(r.path, r.progress): r.eta_s for r in drain(progress.estimates(stream), "eta")}
    assert got == {("a/b", 0.5): 5.0, ("x", 0.25): 30.0, ("a/b", 0.0): pytest.approx(13.0)}
    fired = drain(progress.fire(spark.readStream.schema("track_id long, seq int, arc double").parquet(str(tmp_path / "b"))), "fired")
    acc, want = 0.0, []
    for i in range(9):
        acc += min(1.0, 0.3 / 0.45)
        if acc >= 1:
            acc -= 1
            want.append(i)
    assert sorted(r.seq for r in fired) == want
    s = progress.gap_sessions(spark.createDataFrame([(1, at(0)), (1, at(0.1)), (1, at(1))], "track_id long, ts timestamp"))
    assert sorted(r.n for r in s.collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["patterns-list"]) == 0
    assert len([json.loads(x) for x in capsys.readouterr().out.splitlines()]) > 7
    assert cli.main(["render"]) == 2
    assert cli.main(["query", "no_such_query", SF]) == 1
    spark.createDataFrame([(1, i, i * 500, 0.5) for i in range(40)], "track_id long, seq int, at_ms long, energy double").write.parquet(str(tmp_path / "b"))
    capsys.readouterr()
    for tone in ("flat", "rise", "auto"):
        assert cli.main(["generate-curve", str(tmp_path / "b"), "--tone", tone, "--title", "t"]) == 0
        doc = json.loads(json.loads(capsys.readouterr().out)["doc"])
        assert doc["metadata"]["title"] == "t" and doc["actions"]


def test_bundles_and_sources_of_the_command_line(spark, tmp_path, capsys):
    spark.createDataFrame([(1, i, i * 500, 0.5) for i in range(80)], "track_id long, seq int, at_ms long, energy double").write.parquet(str(tmp_path / "b"))
    bundle = {"chapters": [{"at_ms": 0, "end_ms": 20_000}, {"at_ms": 20_000}], "recipes": [{"stroke_density": "half", "tone": "rise"}, {"stroke_density": "8"}]}
    spark.createDataFrame([(1, json.dumps(bundle))], "track_id long, doc string").write.parquet(str(tmp_path / "r"))
    capsys.readouterr()
    assert cli.main(["generate-curve", str(tmp_path / "b"), "--bundle", str(tmp_path / "r")]) == 0
    points = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    n = [sum(p["chapter_idx"] == k for p in points) for k in (0, 1)]
    assert n[1] > 3 * n[0] > 0
    spark.createDataFrame([(1, json.dumps({**bundle, "recipes": []}))], "track_id long, doc string").write.parquet(str(tmp_path / "w"))
    assert cli.main(["generate-curve", str(tmp_path / "b"), "--bundle", str(tmp_path / "w")]) == 1
    assert cli.main(["generate-curve", str(tmp_path / "b"), "--center-trajectory", "30,70"]) == 0
    chapter = "array<struct<at_ms:bigint,end_ms:bigint,name:string,intent:string>>"
    rows = [(1, 1, "mp4", [(0, None, "B", ""), (20_000, None, "C", ""), (40_000, None, "D", "")]), (1, 0, "sidecar", [(0, None, "A", ""), (15_000, None, "", "talk"), (30_000, None, "", "")])]
    spark.createDataFrame(rows, f"track_id long, priority int, source string, chapters {chapter}").write.parquet(str(tmp_path / "s"))
    capsys.readouterr()
    assert cli.main(["chapters-to-youtube-description", str(tmp_path / "s"), "--sources"]) == 0
    assert json.loads(capsys.readouterr().out)["block"] == "0:00 A\n0:15 talk\n0:30 Chapter 3\n"
