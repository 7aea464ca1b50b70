"""Whole runs over decoded samples: beats with tempo corrections, chapters, stanzas, energy, documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.dsp import plans as dsp
from chronoloom.functions.exprs import TRACK
from chronoloom.operators import modes, structure, tempo, timeline

WHOLE_FILE_S = 480.0


@dataclass(frozen=True)
class Run:
    """What a structural run gives; every field is a DataFrame keyed by track_id."""

    beats: DataFrame
    chapters: DataFrame
    stanzas: DataFrame
    energy: DataFrame
    peaks: DataFrame
    spectrograms: DataFrame


def analyse_beats(samples: DataFrame, *, tracker: str = "auto", locked_bpm: float | None = None, source: str = "full", spans: DataFrame | None = None) -> DataFrame:
    """Beats of every chunk with its tempo corrected (halves lifted, then octaves folded), numbered over the track.

    A chunk, or each of ``spans(track_id, span_idx, start_ms, end_ms)`` such as chapters, is normalised and corrected by
    itself; the track's tempo is the chunks' mean by duration. A locked tempo is not corrected.
    """
    if spans is not None:
        samples = dsp.slices(samples, spans)
    raw = dsp.beats(samples, tracker=tracker, locked_bpm=locked_bpm, source=source)
    key = F.struct(TRACK, "chunk_idx")
    b = raw.select(key.alias(TRACK), "at_ms", "energy", "bpm", "ref_bpm").withColumn("seq", (F.row_number().over(Window.partitionBy(TRACK).orderBy("at_ms")) - 1).cast("int"))
    fixed = b
    if locked_bpm is None:
        t = b.groupBy(TRACK).agg(F.first("bpm").alias("bpm"), F.first("ref_bpm").alias("ref_bpm"))
        lifted = tempo.lift_halves(b.select(TRACK, "seq", "at_ms", "energy"), t)
        fixed = tempo.fold_octaves(lifted, lifted.groupBy(TRACK).agg(F.first("bpm").alias("bpm")))
    flat = fixed.select(F.col(f"{TRACK}.{TRACK}").alias(TRACK), F.col(f"{TRACK}.chunk_idx").alias("chunk_idx"), "at_ms", "energy", "bpm")
    return flat.withColumn("seq", (F.row_number().over(Window.partitionBy(TRACK).orderBy("at_ms", "chunk_idx")) - 1).cast("int"))


def detect_chapters(samples: DataFrame, *, target_s: float = 330.0) -> DataFrame:
    """Chapters (track_id, chapter_idx, at_ms, end_ms) of tracks: one for those under eight minutes, else cuts by sound and silence."""
    n = F.length("data") / 4 / F.col("sr")
    tracks = samples.where("data is not null").groupBy(TRACK).agg(F.max(F.col("start_ms") / 1000 + n).alias("duration"))
    centres = structure.silence_islands(dsp.frame_features(samples).select(TRACK, "frame_idx", "rms", "frame_s")).select(TRACK, "centre")
    long = tracks.where(F.col("duration") >= WHOLE_FILE_S)
    bounds = dsp.track_segments(samples.join(F.broadcast(long.select(TRACK)), TRACK, "left_semi").withColumns({} if "track_s" in samples.columns else {"track_s": F.max(F.col("start_ms") / 1000 + n).over(Window.partitionBy(TRACK))}), target_s)
    cuts = structure.chapter_cuts(long, bounds, centres, target=target_s).unionByName(tracks.where(F.col("duration") < WHOLE_FILE_S).select(TRACK, F.explode(F.array(F.lit(0.0), F.col("duration"))).alias("cut")))
    w = Window.partitionBy(TRACK).orderBy("cut")
    spans = cuts.select(TRACK, (F.row_number().over(w) - 1).alias("chapter_idx"), F.rint(F.col("cut") * 1000).cast("long").alias("at_ms"), F.rint(F.lead("cut").over(w) * 1000).cast("long").alias("end_ms"))
    return spans.where("end_ms is not null")


def texture_name(label: str) -> Column:
    """A texture by its present name; what is neither is varied."""
    return F.when(F.col(label) == "music", "driving").when(F.col(label) == "ambient", "calm").otherwise("varied")


def classified(samples: DataFrame, chapters: DataFrame, probability=None) -> DataFrame:
    """``chapters`` with content_type and confidence by each one's own sound, and voice_label; under a second: unlabelled."""
    own = dsp.slices(samples, chapters.select(TRACK, F.col("chapter_idx").alias("span_idx"), F.col("at_ms").alias("start_ms"), "end_ms"))
    key = F.struct(TRACK, "chunk_idx")
    label = modes.content_label(dsp.textures(own).where("rms_cv is not null").withColumn(TRACK, key).drop("chunk_idx")).select(F.col(f"{TRACK}.{TRACK}").alias(TRACK), F.col(f"{TRACK}.chunk_idx").alias("chapter_idx"), texture_name("label").alias("content_type"), F.round("confidence", 3).alias("confidence"))
    voice = voice_ratio(own, probability).select(TRACK, F.col("chunk_idx").alias("chapter_idx"), "voice_label")
    out = chapters.withColumn("chapter_idx", F.col("chapter_idx").cast("int"))
    out = out.join(label, [TRACK, "chapter_idx"], "left").join(voice, [TRACK, "chapter_idx"], "left")
    return out.withColumns({**{c: F.coalesce(c, F.lit("")) for c in ("content_type", "voice_label")}, "confidence": F.coalesce("confidence", F.lit(0.0))})


def auto_chapter(samples: DataFrame, *, target_minutes: float = 5.5, tracker: str = "auto") -> Run:
    """Chapters, beats, stanza modes, energy per chapter, peaks and spectrograms of all tracks.

    Every part is lazy and reads the same samples; write or cache what several consumers need.
    """
    beats, chapters = analyse_beats(samples, tracker=tracker), detect_chapters(samples, target_s=target_minutes * 60)
    spans = timeline.stanzas(beats)
    return Run(beats, classified(samples, chapters), modes.stanza_records(beats, spans, chapters), tempo.energy_per_chapter(beats, chapters), dsp.peaks(samples), dsp.spectrograms(samples))


def voice_ratio(samples: DataFrame, probability=None) -> DataFrame:
    """Share of 32 ms blocks (16 kHz) that ``probability(block)`` finds at 0.5 or more, and "talk" from 0.6 on; no model: 0."""
    from chronoloom.dsp import kernels

    def rows(y, sr, at, track_s):
        if probability is None or len(y) == 0:
            return [{"voice_ratio": 0.0, "voice_label": ""}]
        z = kernels.resample(y, sr)
        hits = [probability(z[i : i + 512]) >= 0.5 for i in range(0, len(z) - 511, 512)]
        ratio = sum(hits) / len(hits) if hits else 0.0
        return [{"voice_ratio": ratio, "voice_label": "talk" if ratio >= 0.6 else ""}]

    return dsp._per_chunk(samples, rows, "voice_ratio double, voice_label string")
