"""Silences, sessions and chapter cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK


def silence_islands(frames: DataFrame, *, ratio: float = 0.05, min_frames: int = 64, frame_s: float = 512 / 22050, min_s: float = 1.5) -> DataFrame:
    """Runs of ``frames(track_id, frame_idx, rms)`` below ratio times the track's (linear) 95th percentile: their centres.

    Frames may bring their own distance in a column frame_s; the least run is then ``min_s`` long.
    """
    own = "frame_s" in frames.columns
    if not own:
        frames = frames.withColumn("frame_s", F.lit(float(frame_s)))
    ref = frames.groupBy(TRACK).agg(F.percentile("rms", F.lit(0.95)).alias("ref")).where("ref > 0")
    w = Window.partitionBy(TRACK).orderBy("frame_idx")
    f = frames.join(ref, TRACK).select(TRACK, "frame_idx", "frame_s", (F.col("rms") < F.col("ref") * ratio).alias("silent"))
    f = f.select("*", (F.lag("silent").over(w).isNull() | (F.lag("silent").over(w) != F.col("silent"))).cast("int").alias("new"))
    f = f.select("*", F.sum("new").over(w).alias("island")).where("silent")
    least = F.greatest(F.lit(1), F.floor(F.lit(float(min_s)) / F.col("frame_s"))) if own else F.lit(min_frames)
    runs = f.groupBy(TRACK, "island").agg(F.min("frame_idx").alias("first"), F.count("*").alias("n"), F.max("frame_s").alias("frame_s")).where(F.col("n") >= least)
    return runs.select(TRACK, F.col("first").alias("first_frame"), F.col("n").alias("n_frames"), ((F.col("first") + F.col("first") + F.col("n")) / 2 * F.col("frame_s")).alias("centre"))


def sessions(points: DataFrame, *, max_gap: float, min_span: float) -> DataFrame:
    """Points (track_id, at_ms) merged while gaps are at most max_gap; shorter spans go."""
    w = Window.partitionBy(TRACK).orderBy("at_ms")
    p = points.select(TRACK, "at_ms", F.coalesce(F.col("at_ms") - F.lag("at_ms").over(w) > max_gap, F.lit(True)).cast("int").alias("new"))
    s = p.select(TRACK, "at_ms", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session"))
    return s.groupBy(TRACK, "session").agg(F.min("at_ms").alias("start_ms"), F.max("at_ms").alias("end_ms"), F.count("*").alias("n")).where(F.col("end_ms") - F.col("start_ms") >= min_span)


def cut_points(tracks: DataFrame, snapped: DataFrame) -> DataFrame:
    """Each track's ordered set of 0, its duration and the snapped cuts, none beyond the duration (seconds, doubles)."""
    ends = tracks.select(TRACK, F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("cut"))
    inside = snapped.join(tracks, TRACK).select(TRACK, F.least("snapped", "duration").alias("cut"))
    return ends.unionByName(inside).distinct()


def _ordered(cuts: DataFrame) -> DataFrame:
    return cuts.groupBy(TRACK).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))


def merge_micro(cuts: DataFrame, min_duration: float) -> DataFrame:
    """Drop cuts closer than min_duration to the last one kept, but not the ends: a fold, as it hangs on what was kept.

    Cuts of one track are few (minutes apart), so the fold's array is small.
    """

    def fold(c: Column) -> Column:
        last, inner = F.element_at(c, -1), F.slice(c, 2, F.size(c) - 2)
        kept = F.aggregate(inner, F.slice(c, 1, 1), lambda acc, x: F.when(x - F.element_at(acc, -1) >= min_duration, F.array_append(acc, x)).otherwise(acc))
        tail = F.when((F.size(kept) >= 2) & (last - F.element_at(kept, -1) < min_duration), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)
        return F.array_append(tail, last)

    c = F.col("cuts")
    return _ordered(cuts).select(TRACK, F.explode(F.when(F.size(c) <= 2, c).otherwise(fold(c))).alias("cut"))


def enforce_max(cuts: DataFrame, max_duration: float) -> DataFrame:
    """Cut gaps longer than max_duration into equal parts."""
    before = F.lag("cut").over(Window.partitionBy(TRACK).orderBy("cut"))
    g = cuts.select(TRACK, "cut", before.alias("b")).withColumn("gap", F.col("cut") - F.col("b"))
    parts = F.when((F.lit(max_duration) > 0) & (F.col("gap") > max_duration), F.floor(F.col("gap") / F.lit(max_duration or 1.0)).cast("int") + 1).otherwise(1)
    inner = F.when(parts > 1, F.transform(F.sequence(F.lit(1), parts - 1), lambda k: F.col("b") + k * (F.col("gap") / parts))).otherwise(F.array().cast("array<double>"))
    return g.select(TRACK, F.explode(F.concat(inner, F.array("cut"))).alias("cut"))


def chapter_cuts(tracks: DataFrame, boundaries: DataFrame, centres: DataFrame, *, target: float, radius: float = 8.0) -> DataFrame:
    """Snap boundaries to silences, add the ends, merge micro chapters, split over-long ones."""
    from . import timeline

    snapped = timeline.snap_within(boundaries, centres, radius)
    return enforce_max(merge_micro(cut_points(tracks, snapped), 0.4 * target), 1.5 * target)


def scene_cuts(scores: DataFrame, detector: str = "adaptive", threshold: float | None = None, window: int = 2) -> DataFrame:
    """Frames of ``scores(track_id, frame_idx, score)`` where a scene begins.

    content: a score jump over 27; threshold: crossing 12 downward or upward; adaptive: a score over 3 times the mean
    of its neighbours.
    """
    w = Window.partitionBy(TRACK).orderBy("frame_idx")
    x, before = F.col("score"), F.lag("score").over(w)
    if detector == "content":
        cut = F.abs(x - before) >= (27.0 if threshold is None else threshold)
    elif detector == "threshold":
        t = 12.0 if threshold is None else threshold
        cut = (x >= t) != (before >= t)
    elif detector == "adaptive":
        around = w.rowsBetween(-window, window)
        n = F.count("score").over(around) - 1
        mean = F.try_divide(F.sum("score").over(around) - x, n)
        cut = F.try_divide(x, mean) >= (3.0 if threshold is None else threshold)
    else:
        raise ValueError(f"unknown detector {detector!r}")
    return scores.select(TRACK, "frame_idx", cut.alias("cut")).where("cut").select(TRACK, "frame_idx")


def scenes(cuts: DataFrame, tracks: DataFrame, fps: float) -> DataFrame:
    """Scenes (index from 1, start_ms, end_ms, duration_ms) of ``cuts(track_id, frame_idx)`` and ``tracks(track_id, n_frames)``.

    A track without cuts is one scene; frames become milliseconds, rounded half to even.
    """
    starts = tracks.select(TRACK, F.lit(0).cast("long").alias("frame_idx")).unionByName(cuts.select(TRACK, F.col("frame_idx").cast("long"))).distinct()
    w = Window.partitionBy(TRACK).orderBy("frame_idx")
    s = starts.join(tracks, TRACK).where("frame_idx < n_frames").select(TRACK, F.row_number().over(w).alias("index"), F.col("frame_idx").alias("a"), F.coalesce(F.lead("frame_idx").over(w), "n_frames").alias("b"))
    ms = lambda c: F.rint(F.col(c) * 1000 / F.lit(float(fps))).cast("long")
    return s.select(TRACK, "index", ms("a").alias("start_ms"), ms("b").alias("end_ms"), (ms("b") - ms("a")).alias("duration_ms"))


def spectral_flux(frames: DataFrame) -> DataFrame:
    """Mean over a track's steps of the mean positive difference of ``frames(track_id, frame_idx, vec)``."""
    w = Window.partitionBy(TRACK).orderBy("frame_idx")
    step = F.zip_with("vec", F.lag("vec").over(w), lambda a, b: F.greatest(F.lit(0.0), a.cast("double") - b.cast("double")))
    f = frames.select(TRACK, "frame_idx", step.alias("d")).where("d is not null")
    return f.select(TRACK, "frame_idx", (F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("flux"))


def sliding_max(samples: DataFrame, size: int) -> DataFrame:
    """Maximum of |x| over ``size`` samples about each (left-heavy if even), edges repeated."""
    w = Window.partitionBy(TRACK).orderBy("idx").rowsBetween(-(size // 2), size - size // 2 - 1)
    return samples.select(TRACK, "idx", F.max(F.abs("x")).over(w).alias("env"))


def limiter_gain(envelope: DataFrame, *, threshold: float = 0.85, ratio: float = 8.0) -> DataFrame:
    """Static gain: 1 up to the threshold, (threshold / env)**(1 - 1 / ratio) above."""
    return envelope.withColumn("gain", F.when(F.col("env") > threshold, F.pow(F.lit(threshold) / F.col("env"), F.lit(1.0 - 1.0 / ratio))).otherwise(1.0))


def exact_hop_peaks(samples: DataFrame, *, sr: int, hop_ms: float) -> DataFrame:
    """Root mean square of hops whose edges are rint(i hop) with the exact fractional hop, over the track's loudest."""
    hop = sr * hop_ms / 1000
    # the hop that holds sample i: the last edge at or before it
    k = F.floor(F.col("idx") / hop)
    hop_idx = F.when(F.rint((k + 1) * hop) <= F.col("idx"), k + 1).when(F.rint(k * hop) > F.col("idx"), k - 1).otherwise(k).cast("long")
    n = samples.groupBy(TRACK).agg(F.floor(F.count("*") / F.lit(hop)).alias("n_hops"))
    rms = samples.join(n, TRACK).withColumn("hop_idx", hop_idx).where("hop_idx < n_hops").groupBy(TRACK, "hop_idx").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))
    most = F.max("rms").over(Window.partitionBy(TRACK))
    return rms.select(TRACK, "hop_idx", F.when(most > 0, F.col("rms") / most).otherwise(F.col("rms")).alias("peak"))


def sliding_mean(samples: DataFrame, size: int) -> DataFrame:
    """Mean of ``size`` samples about each, the first and last repeated beyond the ends."""
    w, track = Window.partitionBy(TRACK).orderBy("idx"), Window.partitionBy(TRACK)
    left, right = size // 2, size - size // 2 - 1
    around = w.rowsBetween(-left, right)
    first, last = F.first("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("x").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r, n = F.row_number().over(w) - 1, F.count("*").over(track)
    missing_left, missing_right = F.greatest(F.lit(0), left - r), F.greatest(F.lit(0), r + right - (n - 1))
    return samples.select(TRACK, "idx", ((F.sum("x").over(around) + missing_left * first + missing_right * last) / size).alias("mean"))
