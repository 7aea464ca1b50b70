"""Rule ladders that label stanzas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK, nearest_ranks, rank_a

from . import timeline


def _inside(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Points of each span (half-open); an equi-join on track with a range condition, for the few chapters of a track."""
    s = spans.select(F.col(TRACK).alias("__t"), F.col(key), F.col("start_ms").alias("__s"), F.col("end_ms").alias("__e"))
    return points.join(s, (points[TRACK] == s["__t"]) & (F.col("at_ms") >= F.col("__s")) & (F.col("at_ms") < F.col("__e"))).drop("__t", "__s", "__e")


def in_stanzas(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points of each stanza; stanzas don't overlap, so no join is needed."""
    out = timeline.tiled(points, spans.withColumnRenamed("stanza_idx", "span_idx"), F.col("at_ms"), [], last=False)
    return out.where("span_idx is not null").withColumnRenamed("span_idx", "stanza_idx")


def energy_trend(beats: DataFrame, spans: DataFrame) -> DataFrame:
    """Beats of each stanza: count, mean energy, second half's mean and its lead over the first; one beat: trend 0."""
    key = "stanza_idx"
    w = Window.partitionBy(TRACK, key)
    b = in_stanzas(beats, spans).select("*", (F.row_number().over(w.orderBy("seq")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    second = F.col("k") >= F.floor(F.col("n") / 2)
    a = b.groupBy(TRACK, key).agg(F.count("*").alias("n_beats"), F.avg("energy").alias("avg_energy"), F.avg(F.when(~second, F.col("energy"))).alias("first"), F.avg(F.when(second, F.col("energy"))).alias("second_avg"))
    return a.select(TRACK, key, "n_beats", "avg_energy", F.coalesce(F.col("second_avg") - F.col("first"), F.lit(0.0)).alias("trend"), "second_avg")


def _ladder(*rules: tuple[Column, str], default: str) -> Column:
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def modes_whole(beats: DataFrame, spans: DataFrame) -> DataFrame:
    """Modes against the whole track: energy percentiles of all beats, median density of the stanzas that have beats."""
    q = nearest_ranks(beats, [TRACK], "energy", {"p15": (rank_a, 0.15), "p40": (rank_a, 0.4), "p50": (rank_a, 0.5)})
    secs = F.greatest(F.lit(1e-6), (F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0))
    stats = spans.join(energy_trend(beats, spans), [TRACK, "stanza_idx"], "left").withColumn("density", F.coalesce("n_beats", F.lit(0)) / secs)
    median = nearest_ranks(stats.where("n_beats > 0"), [TRACK], "density", {"med": (rank_a, 0.5)})
    s = stats.join(q, TRACK).join(median, TRACK, "left")
    mode = _ladder(
        (F.col("n_beats").isNull() | (F.col("avg_energy") < F.greatest(F.col("p15"), F.lit(0.08))), "break"), ((F.col("trend") >= 0.15) & (F.col("second_avg") >= F.col("p50")), "edging"),
        ((F.col("med") > 0) & (F.col("density") >= F.col("med") * 1.25), "fast"), ((F.col("med") > 0) & (F.col("density") <= F.col("med") * 0.75), "slow"), (F.col("avg_energy") < F.col("p40"), "tease"), default="steady",
    )
    return s.select(TRACK, "stanza_idx", "start_ms", "end_ms", mode.alias("mode"))


def modes_per_chapter(beats: DataFrame, spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """Modes against the chapter that a stanza starts in: median energy and beats a minute of that chapter.

    ``chapters(track_id, chapter_idx, at_ms, end_ms)``; stanzas in no chapter are left out, in several once for each.
    """
    d = timeline.durations(beats)
    ch = chapters.join(d, TRACK).select(TRACK, "chapter_idx", F.col("at_ms").alias("start_ms"), F.coalesce("end_ms", "duration_ms").alias("end_ms"))
    minutes = F.greatest(F.lit(1e-6), (F.col("end_ms") - F.col("start_ms")) / F.lit(60000.0))
    own = _inside(beats, ch, "chapter_idx").groupBy(TRACK, "chapter_idx").agg(F.median("energy").alias("med"), F.count("*").alias("n"))
    ref = ch.join(own, [TRACK, "chapter_idx"], "left").select(TRACK, "chapter_idx", "med", (F.col("n") / minutes).alias("bpm"))
    placed = _inside(spans.withColumn("at_ms", F.col("start_ms")), ch, "chapter_idx").drop("at_ms")
    s = placed.join(energy_trend(beats, spans), [TRACK, "stanza_idx"], "left").join(ref, [TRACK, "chapter_idx"])
    mode = _ladder(
        (F.col("n_beats").isNull() | F.col("med").isNull() | (F.col("avg_energy") < F.greatest(F.col("med") * 0.4, F.lit(0.1))), "break"), ((F.col("trend") >= 0.15) & (F.col("second_avg") >= F.col("med")), "edging"),
        (F.col("bpm") >= 140, "fast"), (F.col("bpm") <= 75, "slow"), (F.col("avg_energy") < F.col("med") * 0.85, "tease"), default="steady",
    )
    return s.select(TRACK, "stanza_idx", "chapter_idx", "start_ms", "end_ms", mode.alias("mode"))


def chapter_of(spans: DataFrame, chapters: DataFrame) -> DataFrame:
    """The chapter at each span's midpoint; outside every chapter the last one."""
    ch = chapters.select(TRACK, F.col("chapter_idx").alias("span_idx"), F.col("at_ms").alias("start_ms"), "end_ms")
    points = spans.select("*", F.col("stanza_idx").alias("point_id"))
    return timeline.containing(points, ch, F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long"), [], last=True).drop("point_id").withColumnRenamed("span_idx", "chapter_idx")


def stanza_records(beats: DataFrame, spans: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Modes with the chapter of each stanza; without chapters against the whole track, in chapter 0."""
    if chapters is None:
        return modes_whole(beats, spans).withColumn("chapter_idx", F.lit(0))
    placed = chapter_of(spans.select(TRACK, "stanza_idx", "start_ms", "end_ms"), chapters).select(TRACK, "stanza_idx", F.col("chapter_idx"))
    return modes_per_chapter(beats, spans, chapters).drop("chapter_idx").join(placed, [TRACK, "stanza_idx"])


def action_modes(actions: DataFrame, spans: DataFrame, chapters: DataFrame | None = None) -> DataFrame:
    """Modes from actions: amplitude, density and growth of each stanza, absolute or against its chapter's amplitude."""
    w = Window.partitionBy(TRACK, "stanza_idx")
    a = in_stanzas(actions, spans).select("*", (F.row_number().over(w.orderBy("at_ms", "seq")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    second = F.col("k") >= F.floor(F.col("n") / 2)
    width = lambda c: F.max(F.when(c, F.col("pos"))) - F.min(F.when(c, F.col("pos")))
    stats = a.groupBy(TRACK, "stanza_idx").agg(F.count("*").alias("n"), (F.max("pos") - F.min("pos")).alias("amp"), F.coalesce(width(~second), F.lit(0)).alias("first_amp"), F.coalesce(width(second), F.lit(0)).alias("second_amp"))
    s = spans.select(TRACK, "stanza_idx", "start_ms", "end_ms")
    if chapters is None:
        s = s.select("*", F.lit(0).alias("chapter_idx"), F.lit(15.0).alias("brk"), F.lit(30.0).alias("tease"), F.lit(35.0).alias("edge"))
    else:
        last = actions.groupBy(TRACK).agg(F.max("at_ms").alias("last"))
        ch = chapters.join(last, TRACK).select(TRACK, "chapter_idx", F.col("at_ms").alias("start_ms"), F.coalesce("end_ms", "last").alias("end_ms"))
        ref = ch.join(_inside(actions, ch, "chapter_idx").groupBy(TRACK, "chapter_idx").agg((F.max("pos") - F.min("pos")).cast("double").alias("amp")), [TRACK, "chapter_idx"], "left").select(TRACK, "chapter_idx", F.coalesce("amp", F.lit(0.0)).alias("ref"))
        s = chapter_of(s, chapters).join(ref, [TRACK, "chapter_idx"]).select(TRACK, "stanza_idx", "start_ms", "end_ms", "chapter_idx", F.greatest(F.col("ref") * 0.4, F.lit(10.0)).alias("brk"), (F.col("ref") * 0.85).alias("tease"), F.col("ref").alias("edge"))
    s = s.join(stats, [TRACK, "stanza_idx"], "left").withColumn("density", F.col("n") * F.lit(1000.0) / F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")))
    mode = _ladder(
        (F.coalesce("n", F.lit(0)) < 2, "break"), (F.col("amp") < F.col("brk"), "break"), ((F.col("second_amp") - F.col("first_amp") >= 15) & (F.col("second_amp") >= F.col("edge")), "edging"),
        (F.col("density") >= 4, "fast"), (F.col("density") <= 0.8, "slow"), (F.col("amp") < F.col("tease"), "tease"), default="steady",
    )
    return s.select(TRACK, "stanza_idx", F.col("chapter_idx").cast("int").alias("chapter_idx"), "start_ms", "end_ms", mode.alias("mode"))


def content_label(features: DataFrame) -> DataFrame:
    """Texture of ``features(track_id, rms_cv, percussive, flux)``: music, ambient or none, and its confidence."""
    cv, pr, fl = F.col("rms_cv"), F.col("percussive"), F.col("flux")
    w = lambda c, x: F.when(c, x).otherwise(0.0)
    music = w(cv > 0.6, 0.35) + w(pr > 0.45, 0.35) + w(fl > 0.35, 0.3)
    ambient = w(cv < 0.3, 0.35) + w(pr < 0.25, 0.35) + w(fl < 0.15, 0.3)
    s = features.select(TRACK, music.alias("music"), ambient.alias("ambient"))
    label = F.when((F.col("music") >= 0.6) & (F.col("music") - F.col("ambient") > 0.2), "music").when((F.col("ambient") >= 0.6) & (F.col("ambient") - F.col("music") > 0.2), "ambient").otherwise("")
    sure = F.least(F.lit(1.0), 0.5 + F.greatest("music", "ambient") / 2)
    return s.select(TRACK, label.alias("label"), F.when(label != "", sure).otherwise(0.5 + F.abs(F.col("music") - F.col("ambient")) / 4).alias("confidence"))
