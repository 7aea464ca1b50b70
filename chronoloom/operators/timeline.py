"""Stanzas, chunks, and joins of points and intervals; every one is keyed by track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK, by_time, upper_median, with_ranks

STANZA = 16
FALLBACK_GAP_MS = 480


def beats_in_range(beats: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return beats.where((F.col("at_ms") >= start_ms) & (F.col("at_ms") < end_ms))


def downbeats(beats: DataFrame) -> DataFrame:
    """Every fourth beat."""
    return beats.where(F.col("seq") % 4 == 0).select(TRACK, "seq", "at_ms")


def stanzas(beats: DataFrame, size: int = STANZA) -> DataFrame:
    """Runs of 16 beats; the last ends on the last beat, so half-open membership leaves that beat out."""
    last = F.max("at_ms").over(Window.partitionBy(TRACK))
    grouped = beats.withColumn("last", last).groupBy(TRACK, F.floor(F.col("seq") / size).cast("int").alias("stanza_idx")).agg(F.min("at_ms").alias("start_ms"), F.first("last").alias("last"))
    return grouped.select(TRACK, "stanza_idx", "start_ms", F.coalesce(F.lead("start_ms").over(Window.partitionBy(TRACK).orderBy("stanza_idx")), "last").alias("end_ms"))


def action_stanzas(actions: DataFrame, size: int = STANZA) -> DataFrame:
    """Runs of 16 actions; the last ends one past the last action."""
    grouped = actions.groupBy(TRACK, F.floor(F.col("seq") / size).cast("int").alias("stanza_idx")).agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("last"))
    return grouped.select(TRACK, "stanza_idx", "start_ms", F.coalesce(F.lead("start_ms").over(Window.partitionBy(TRACK).orderBy("stanza_idx")), F.col("last") + 1).alias("end_ms"))


def next_durations(beats: DataFrame) -> DataFrame:
    """Time to the next beat; for the last the upper median gap; 480 where there is only one beat."""
    lead = beats.select("*", (F.lead("at_ms").over(by_time()) - F.col("at_ms")).alias("gap"))
    ranked = with_ranks(lead, [TRACK], "gap", {"__median": (upper_median, 0.5)})
    return ranked.withColumn("dur_ms", F.coalesce("gap", "__median", F.lit(FALLBACK_GAP_MS)).cast("long")).drop("gap", "__median")


def durations(beats: DataFrame) -> DataFrame:
    return beats.groupBy(TRACK).agg(F.max("at_ms").alias("duration_ms"))


def time_chunks(tracks: DataFrame, chunk_secs: float = 15.0) -> DataFrame:
    """Equal chunks of [0, duration_ms); a last one shorter than a half joins the one before."""
    size = max(1000, round(chunk_secs * 1000))
    d = F.col("duration_ms")
    n = F.greatest(F.lit(1), F.ceil(d / size))
    n = F.when((n > 1) & (d - (n - 1) * size < size * 0.5), n - 1).otherwise(n)
    each = tracks.select(TRACK, "duration_ms", n.cast("int").alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_idx"))
    return each.select(TRACK, "chunk_idx", (F.col("chunk_idx").cast("long") * size).alias("at_ms"), F.when(F.col("chunk_idx") == F.col("n") - 1, d).otherwise((F.col("chunk_idx").cast("long") + 1) * size).alias("end_ms"))


def nearest_beat(probes: DataFrame, beats: DataFrame, direction: str = "nearest") -> DataFrame:
    """As-of join of ``probes(track_id, probe_id, at_ms)`` by one union and running windows, never a range join.

    before: the last beat at or before, else the first; after: the first beat behind, else the last; nearest: the
    closer of the two, the earlier on a tie. Tracks without beats give null.
    """
    if direction not in ("before", "after", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    both = beats.select(TRACK, "at_ms", F.lit(0).alias("kind"), F.col("at_ms").alias("beat"), F.lit(None).cast("long").alias("probe_id")).unionByName(probes.select(TRACK, "at_ms", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("beat"), F.col("probe_id").cast("long")))
    w = Window.partitionBy(TRACK).orderBy("at_ms", "kind", "probe_id")
    before = F.last("beat", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("beat", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.select("*", before.alias("b"), after.alias("a")).where("kind = 1")
    t, b, a = F.col("at_ms"), F.coalesce("b", "a"), F.coalesce("a", "b")
    pick = {"before": b, "after": a, "nearest": F.when(F.abs(b - t) <= F.abs(a - t), b).otherwise(a)}[direction]
    return found.select(TRACK, "probe_id", "at_ms", pick.alias("beat_ms"))


def snap_within(points: DataFrame, centres: DataFrame, radius: float) -> DataFrame:
    """Each ``points(track_id, at)`` moves to the nearest of ``centres(track_id, centre)`` within radius, the smaller on a tie."""
    both = centres.select(TRACK, F.col("centre").alias("at"), F.lit(0).alias("kind"), "centre").unionByName(points.select(TRACK, "at", F.lit(1).alias("kind"), F.lit(None).cast("double").alias("centre")))
    w = Window.partitionBy(TRACK).orderBy("at", "kind")
    found = both.select("*", F.last("centre", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("b"), F.first("centre", True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("a")).where("kind = 1")
    at = F.col("at")
    near = F.when(F.col("a").isNull() | (at - F.col("b") <= F.col("a") - at), F.col("b")).otherwise(F.col("a"))
    return found.select(TRACK, "at", F.when(F.abs(near - at) <= radius, near).otherwise(at).alias("snapped"))


def tiled(points: DataFrame, spans: DataFrame, at: Column, columns: list[str], *, last: bool) -> DataFrame:
    """``containing`` for spans that don't overlap, as stanzas and chunks: one union and running windows by track.

    No join, so a track of very many points and spans costs one sort; each point takes the last span that starts at or
    before it, if that one reaches it.
    """
    s = spans.select(TRACK, F.struct("span_idx", F.coalesce("end_ms", F.lit(1 << 62)).alias("end"), *columns).alias("span"), F.col("start_ms").alias("at"))
    p = points.select(TRACK, F.struct(*[F.col(c) for c in points.columns]).alias("point"), at.alias("at"))
    both = s.select(TRACK, "at", "span", F.lit(None).cast(p.schema["point"].dataType).alias("point")).unionByName(p.select(TRACK, "at", F.lit(None).cast(s.schema["span"].dataType).alias("span"), "point"))
    upto = Window.partitionBy(TRACK).orderBy("at", F.col("point").isNotNull(), "span.span_idx").rowsBetween(Window.unboundedPreceding, 0)
    found = both.select("at", "point", F.last("span", True).over(upto).alias("hit"), *([F.max_by("span", "span.span_idx").over(Window.partitionBy(TRACK)).alias("ending")] if last else [])).where("point is not null")
    hit = F.when(F.col("at") < F.col("hit.end"), F.col("hit"))
    found = found.select("point", (F.coalesce(hit, F.col("ending")) if last else hit).alias("hit"))
    return found.select(*[F.col(f"point.{c}").alias(c) for c in points.columns], *[F.col(f"hit.{c}").alias(c) for c in ["span_idx", *columns]])


def containing(points: DataFrame, spans: DataFrame, at: Column, columns: list[str], *, last: bool) -> DataFrame:
    """Left interval join on track: for each point the first span (by span_idx) with start_ms <= at < end_ms.

    last: points outside every span take the last span instead of nulls. Null end_ms reaches to infinity.
    points needs a unique ``point_id`` within its track.
    """
    payload = F.struct("span_idx", *columns)
    s = spans.select(F.col(TRACK).alias("__t"), F.col("start_ms").alias("__s"), F.coalesce("end_ms", F.lit(1 << 62)).alias("__e"), F.col("span_idx").alias("__i"), payload.alias("__p"))
    p = points.withColumn("__at", at)
    hit = p.join(s, (p[TRACK] == s["__t"]) & (F.col("__at") >= F.col("__s")) & (F.col("__at") < F.col("__e")), "left")
    # of several spans the first stays; this window keeps the join's partitioning by track
    out = hit.withColumn("__n", F.row_number().over(Window.partitionBy(TRACK, "point_id").orderBy("__i"))).where("__n = 1")
    if last:
        ends = spans.groupBy(TRACK).agg(F.max_by(payload, "span_idx").alias("__l"))
        out = out.join(ends, TRACK, "left").withColumn("__p", F.coalesce("__p", "__l"))
    return out.select(*[F.col(c) for c in points.columns], *[F.col(f"__p.{c}").alias(c) for c in ["span_idx", *columns]])


def mark_downbeats(beats: DataFrame, down: DataFrame) -> DataFrame:
    """is_downbeat: whether the time is among the track's downbeats."""
    d = down.select(TRACK, "at_ms", F.lit(True).alias("d")).distinct()
    return beats.join(d, [TRACK, "at_ms"], "left").select(TRACK, "seq", "at_ms", F.coalesce("d", F.lit(False)).alias("is_downbeat"))


def slice_beats(beats: DataFrame, spans: DataFrame, start_ms: int, end_ms: int) -> tuple[DataFrame, DataFrame]:
    """Beats inside a window, and the spans that overlap it, whole."""
    return beats_in_range(beats, start_ms, end_ms), spans.where((F.col("end_ms") > start_ms) & (F.col("start_ms") < end_ms))


def loudest(beats: DataFrame, least: float = 0.85, k: int = 5) -> DataFrame:
    """The first k beats louder than ``least``."""
    return beats.where(F.col("energy") > least).withColumn("r", F.row_number().over(by_time())).where(F.col("r") <= k).drop("r")
