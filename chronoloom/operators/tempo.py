"""Tempo estimates and corrections, and energy normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK, by_time, nearest_ranks, rank_a, rank_b, upper_median, with_ranks

CEILING, FLOOR = 165.0, 70.0


def bpm(beats: DataFrame) -> DataFrame:
    """60000 over the upper median gap; 0 where there is none."""
    gaps = beats.select(TRACK, (F.col("at_ms") - F.lag("at_ms").over(by_time())).alias("gap"))
    median = nearest_ranks(gaps, [TRACK], "gap", {"gap": (upper_median, 0.5)})
    return beats.select(TRACK).distinct().join(median, TRACK, "left").select(TRACK, F.when(F.col("gap") > 0, F.lit(60000.0) / F.col("gap")).otherwise(0.0).alias("bpm"))


def max_normalised(beats: DataFrame, *keys: str) -> DataFrame:
    """energy over its maximum of the track (and keys, as chunks); 0 where that isn't positive."""
    most = F.max("energy").over(Window.partitionBy(TRACK, *keys))
    return beats.withColumn("energy", F.when(most > 0, F.col("energy") / most).otherwise(0.0))


def p95_normalised(beats: DataFrame) -> DataFrame:
    """norm: energy over the 95th-percentile beat's, at most 1; over the maximum where that is 0; as it is where all are 0."""
    b = with_ranks(beats, [TRACK], "energy", {"__p95": (rank_a, 0.95), "__most": (lambda n, q: n - 1, 1)})
    ref = F.when(F.col("__p95") == 0, F.col("__most")).otherwise(F.col("__p95"))
    return b.withColumn("norm", F.when(ref > 0, F.least(F.lit(1.0), F.col("energy") / ref)).otherwise(F.col("energy"))).drop("__p95", "__most")


def fold_octaves(beats: DataFrame, tempo: DataFrame, *, ceiling: float = CEILING, floor: float = FLOOR, passes: int = 9) -> DataFrame:
    """Halve tempos above the ceiling (while half is not below the floor and four beats are left): of the even and odd
    beats the louder stay, even ones on a tie. Nine halvings take any tempo of beats at whole milliseconds (60,000).
    """
    out = beats.select(TRACK, "seq", "at_ms", "energy").join(tempo, TRACK)
    w = Window.partitionBy(TRACK)
    for _ in range(passes):
        odd = F.sum(F.when(F.col("seq") % 2 == 1, F.col("energy")).otherwise(0.0)).over(w)
        even = F.sum(F.when(F.col("seq") % 2 == 0, F.col("energy")).otherwise(0.0)).over(w)
        fold = (F.col("bpm") > ceiling) & (F.col("bpm") / 2 >= floor) & (F.count("*").over(w) >= 4)
        out = out.select("*", fold.alias("fold"), F.when(even >= odd, 0).otherwise(1).alias("keep"))
        out = out.where(~F.col("fold") | (F.col("seq") % 2 == F.col("keep")))
        out = out.select(TRACK, F.when(F.col("fold"), F.floor(F.col("seq") / 2)).otherwise(F.col("seq")).cast("int").alias("seq"), "at_ms", "energy", F.when(F.col("fold"), F.col("bpm") / 2).otherwise(F.col("bpm")).alias("bpm"))
    return out


def lift_halves(beats: DataFrame, tempo: DataFrame, *, ceiling: float = CEILING, low: float = 1.7, high: float = 2.3) -> DataFrame:
    """Where an independent tempo (ref_bpm) is about twice the found one, put a beat into the middle of each long gap."""
    b = beats.join(tempo, TRACK).withColumn("n", F.count("*").over(Window.partitionBy(TRACK)))
    ratio = F.try_divide("ref_bpm", "bpm")
    lift = F.coalesce((F.col("ref_bpm") > 0) & (F.col("bpm") > 0) & (F.col("n") >= 4) & (F.col("bpm") * 2 <= ceiling) & ratio.between(low, high), F.lit(False))
    nxt, ne = F.lead("at_ms").over(by_time()), F.lead("energy").over(by_time())
    split = lift & (nxt - F.col("at_ms") >= F.try_divide(F.lit(60000.0), F.col("bpm") * 2) * 1.5)
    own = F.struct("at_ms", "energy")
    middle = F.struct(F.floor((F.col("at_ms") + nxt) / 2).cast("long").alias("at_ms"), ((F.col("energy") + ne) / 2).alias("energy"))
    points = b.select(TRACK, "seq", F.when(lift, F.col("bpm") * 2).otherwise(F.col("bpm")).alias("bpm"), F.when(split, F.array(own, middle)).otherwise(F.array(own)).alias("p"))
    each = points.select(TRACK, "seq", "bpm", F.posexplode("p").alias("k", "x"))
    return each.select(TRACK, (F.row_number().over(Window.partitionBy(TRACK).orderBy("seq", "k")) - 1).cast("int").alias("seq"), F.col("x.at_ms").alias("at_ms"), F.col("x.energy").alias("energy"), "bpm")


def weighted_bpm(spans: DataFrame) -> DataFrame:
    """Mean of ``spans(track_id, bpm, dur_ms)`` weighted by duration; 0 without weight."""
    return spans.groupBy(TRACK).agg(F.sum(F.col("bpm") * F.col("dur_ms")).alias("a"), F.sum("dur_ms").alias("b")).select(TRACK, F.when(F.col("b") > 0, F.col("a") / F.col("b")).otherwise(0.0).alias("bpm"))


ENERGY = {f"p{q}": (rank_b, q / 100) for q in (5, 25, 50, 75, 95)}


def energy_percentiles(beats: DataFrame, *keys: str) -> DataFrame:
    return nearest_ranks(beats, [TRACK, *keys], "energy", ENERGY)


def energy_per_chapter(beats: DataFrame, chapters: DataFrame) -> DataFrame:
    """Percentiles and tempo of each chapter that has beats: ``chapters(track_id, chapter_idx, at_ms, end_ms)``."""
    d = beats.groupBy(TRACK).agg(F.max("at_ms").alias("duration_ms"))
    ch = chapters.join(d, TRACK).select(TRACK, "chapter_idx", F.col("at_ms").alias("s"), F.coalesce("end_ms", "duration_ms").alias("e"), "duration_ms")
    inside = beats.join(ch, TRACK).where("at_ms >= s and at_ms < e")
    tempo = inside.groupBy(TRACK, "chapter_idx").agg(F.count("*").alias("n"), F.first((F.greatest(F.lit(0), F.least("e", "duration_ms") - F.col("s"))) / 1000).alias("secs"))
    return energy_percentiles(inside, "chapter_idx").join(tempo, [TRACK, "chapter_idx"]).select(TRACK, "chapter_idx", *ENERGY, F.when(F.col("secs") > 0, F.lit(60.0) * F.col("n") / F.col("secs")).alias("bpm"))
