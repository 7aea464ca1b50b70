"""Planning tables of the media shell: clips, caches, probes, catalogs, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK


def sanitised(stem: Column) -> Column:
    """A file stem of letters, digits, dot, dash and underscore; "media" if nothing is left."""
    clean = F.btrim(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), F.lit("._"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("media"))


def _parts(path: Column) -> tuple[Column, Column, Column]:
    """Folder (with its slash), stem and suffix (with its dot) of a path; a leading or closing dot begins no suffix."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)
    return F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.left(name, F.length(name) - F.length(suffix)), suffix


#: Kinds of documents beside a recording, in its hidden folder.
SIDECARS = ("chapters", "audio", "spectrogram", "beats", "stanzas")


def project_dir(path: Column) -> Column:
    """The hidden folder of a recording, beside it."""
    folder, stem, _ = _parts(path)
    return F.concat(folder, F.lit("."), stem, F.lit(".forge"))


def sidecar_path(path: Column, kind: str) -> Column:
    if kind not in SIDECARS:
        raise ValueError(f"unknown sidecar {kind!r}")
    return F.concat(project_dir(path), F.lit("/"), _parts(path)[1], F.lit(f".{kind}.json"))


#: Part of clips' names, so that clips of other encodings aren't found again.
CLIP_VERSION = "v13"
#: Sources wider than this are scaled down to 720 lines; sources wider than that aren't played as they are.
DOWNSCALE_OVER, DIRECT_PLAY_WIDTH = 1920, 2560


def clip_path(path: Column, start_ms: Column, end_ms: Column, version: str = CLIP_VERSION) -> Column:
    """Where a chapter's clip lies; no hash, so that other programs find it too."""
    _, stem, suffix = _parts(path)
    kind = F.coalesce(F.nullif(F.lower(F.substring(suffix, 2, 100)), F.lit("")), F.lit("mp4"))
    name = F.concat_ws("_", sanitised(stem), F.lit(version), start_ms.cast("long"), end_ms.cast("long"))
    return F.concat(project_dir(path), F.lit("/clips/"), name, F.lit("."), kind)


def clip_plan(media: DataFrame, chapters: DataFrame, clips: DataFrame) -> DataFrame:
    """Each chapter's clip: its path, how to encode it, and whether it is there already.

    ``media(media_id, path, width)``, width null if the probe failed; ``chapters(media_id, chapter_idx, at_ms, end_ms)``;
    ``clips(path)``: those that exist. Chapters without an end are left out; status is "rejected" where the end doesn't
    lie behind the start, "cached" or "build".
    """
    rows = chapters.where("end_ms is not null").join(media, "media_id")
    rows = rows.select("media_id", "chapter_idx", "at_ms", "end_ms", "width", clip_path(F.col("path"), F.col("at_ms"), F.col("end_ms")).alias("clip"))
    there = clips.select(F.col("path").alias("clip"), F.lit(True).alias("there")).distinct()
    status = F.when(F.col("end_ms") <= F.col("at_ms"), "rejected").when(F.col("there"), "cached").otherwise("build")
    encode = F.when(F.coalesce(F.col("width") > DOWNSCALE_OVER, F.lit(False)), "720p").otherwise("source")
    return rows.join(there, "clip", "left").select("media_id", "chapter_idx", "clip", encode.alias("encode"), status.alias("status"))


def clip_batch(plan: DataFrame, failed: DataFrame) -> DataFrame:
    """One line per recording over its clips, once they were made but for ``failed(clip)``."""
    p = plan.where("status <> 'rejected'").join(failed.select("clip", F.lit(True).alias("bad")).distinct(), "clip", "left")
    n = lambda c: F.count(F.when(c, 1))
    g = p.groupBy("media_id").agg(F.count("*").alias("total"), n(F.col("status") == "cached").alias("cached"), n((F.col("status") == "build") & F.col("bad").isNull()).alias("built"))
    return g.select("*", F.format_string("%d/%d clips ready (%d cached, %d built)", F.col("built") + F.col("cached"), "total", "cached", "built").alias("summary"))


def cache_key(path: Column, mtime_ns: Column, size: Column, sr: int = 22050, version: str = "1") -> Column:
    """Sixteen hex digits over what an extraction depends on; empty for a file that can't be read (null time or size)."""
    key = F.substring(F.sha2(F.concat_ws("|", path, mtime_ns.cast("string"), size.cast("string"), F.lit(str(sr)), F.lit(version)), 256), 1, 16)
    return F.when(mtime_ns.isNull() | size.isNull(), "").otherwise(key)


def cache_slot(key: Column, folder: str) -> Column:
    """Where a key's extracted samples lie; null for no key."""
    return F.when(key != "", F.concat(F.lit(folder.rstrip("/") + "/fa-"), key, F.lit(".wav")))


def cache_lookup(files: DataFrame, slots: DataFrame, *, folder: str, sr: int = 22050) -> DataFrame:
    """Which of ``files(media_id, path, mtime_ns, size)`` were extracted before.

    ``slots(path, length, meta)``: what lies in the cache folder, meta being the text beside it. A slot counts if it has
    bytes; an unreadable meta only loses damaged_after_ms. load_path: where to read samples; null: extract first.
    """
    f = files.select("media_id", cache_slot(cache_key(F.col("path"), F.col("mtime_ns"), F.col("size"), sr), folder).alias("slot"))
    s = slots.where("length > 0").select(F.col("path").alias("slot"), F.get_json_object("meta", "$.damaged_after_ms").try_cast("long").alias("damaged_after_ms"), F.lit(True).alias("there"))
    return f.join(s, "slot", "left").select("media_id", "slot", F.coalesce("there", F.lit(False)).alias("hit"), F.when(F.col("there"), F.col("slot")).alias("load_path"), "damaged_after_ms")


AUDIO = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "opus")


def load_paths(files: DataFrame, lookup: DataFrame) -> DataFrame:
    """How each of ``files(media_id, path)`` is read: sound files as they are, others from the cache (``cache_lookup``), the
    rest after an extraction into their slot (null: no slot, so a scratch file)."""
    kind = F.lower(F.substring(_parts(F.col("path"))[2], 2, 20))
    f = files.select("media_id", "path", kind.isin(*AUDIO).alias("sound")).join(lookup.select("media_id", "slot", "hit", "damaged_after_ms"), "media_id", "left")
    how = F.when(F.col("sound"), "as is").when(F.col("hit"), "cached").otherwise("extract")
    return f.select("media_id", how.alias("how"), F.when(F.col("sound"), F.col("path")).otherwise(F.col("slot")).alias("load_path"), F.when(~F.col("sound"), F.col("damaged_after_ms")).alias("damaged_after_ms"))


def stale(files: DataFrame, now_s: float, max_age_s: float = 3600) -> DataFrame:
    """Files (path, modificationTime, length) older than max_age_s: how many, how many bytes."""
    old = files.where(F.unix_micros("modificationTime") / 1e6 < now_s - max_age_s)
    return old.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def ema(durations: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Exponential mean of a track's values in order: a fold, as each step rounds."""
    items = F.array_sort(F.collect_list(F.struct("seq", F.col("at_ms").cast("double").alias("x"))))
    fold = F.aggregate(items, F.lit(None).cast("double"), lambda acc, e: F.when(acc.isNull(), e["x"]).otherwise(alpha * e["x"] + (1.0 - alpha) * acc))
    return durations.groupBy(TRACK).agg(fold.alias("ema"))


def eta(total: Column, progress: Column, elapsed: Column) -> Column:
    """Time left: from a learnt total, else in proportion to what has elapsed."""
    return F.when(total.isNotNull(), total * (1 - progress)).otherwise(F.try_divide(elapsed * (1 - progress), progress))


def constant_rate(real: Column, average: Column) -> Column:
    """Whether two frame rates agree to one percent; unknown ones don't."""
    return F.coalesce((average > 0) & (real > 0) & (F.abs(average - real) <= F.lit(0.01) * real), F.lit(False))


def frame_rate(text: Column) -> Column:
    """"30000/1001" as a number; null if it is none."""
    p = F.split(text, "/")
    return F.try_divide(F.expr("1D") * F.get(p, F.lit(0)).try_cast("double"), F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0)))


PROBE = "struct<streams:array<struct<codec_type:string,codec_name:string,pix_fmt:string,profile:string,width:int,color_transfer:string,color_primaries:string,avg_frame_rate:string,r_frame_rate:string>>>"


def first_video(probe: Column) -> Column:
    """The first video stream of a probe's JSON, as a struct; null if there is none or the text can't be read."""
    return F.get(F.filter(F.from_json(probe, PROBE)["streams"], lambda s: s["codec_type"] == "video"), 0)


def direct_play(media: DataFrame) -> DataFrame:
    """Whether each of ``media(media_id, video)`` plays as it is; no clips are needed then. video: see ``first_video``.

    H.264 of 8 bits with 4:2:0 colours (an unnamed pixel format passes), no 10-bit, 422 or 444 profile, not wider than
    DIRECT_PLAY_WIDTH (an unknown width passes), no high dynamic range, a constant frame rate. No video: no.
    """
    v = F.col("video")
    low = lambda name: F.coalesce(F.lower(v[name]), F.lit(""))
    cfr = constant_rate(frame_rate(v["r_frame_rate"]), frame_rate(v["avg_frame_rate"]))
    plain = (low("codec_name") == "h264") & low("pix_fmt").isin("", "yuv420p") & ~(low("profile").contains("10") | low("profile").contains("422") | low("profile").contains("444")) & (F.coalesce(v["width"], F.lit(0)) <= DIRECT_PLAY_WIDTH)
    hdr = low("color_transfer").isin("smpte2084", "arib-std-b67") | (low("color_primaries") == "bt2020")
    return media.select("media_id", cfr.alias("cfr"), F.coalesce(plain & ~hdr & cfr, F.lit(False)).alias("direct"))


def coverage_shortfall(decoded_ms: Column, source_ms: Column, tolerance: float = 0.02, min_gap_ms: int = 5000) -> Column:
    """A warning where less than 98 % was decoded and 5 s or more are missing."""
    gap = source_ms - decoded_ms
    return F.when((source_ms > 0) & (decoded_ms < source_ms * (1 - tolerance)) & (gap >= min_gap_ms), F.format_string("decoded %d of %d ms", decoded_ms.cast("long"), source_ms.cast("long")))


def salvage_to(rc: Column, last_us: Column) -> Column:
    """Seconds up to which a corrupt stream is decoded again: 8 s before the last good one, if 30 s were good."""
    to = last_us / 1e6 - 8
    return F.when((rc != 0) & (last_us >= 30_000_000) & (to > 1), to)


def progress_us(line: Column) -> Column:
    return F.regexp_extract(line, r"^out_time_us=(\d+)\s*$", 1).try_cast("long")


_BODY, _ALL = ("full_body", "torso"), ("full_body", "torso", "cushion", "wrists")
#: id -> label, where it plays, parameters as name: (default, least, most, step)
PATTERNS = {
    "h_pulse": ("Pulse", _ALL, {"period_ms": (600, 100, 2000, 50), "depth": (0.6, 0, 1, 0.05), "duty": (0.5, 0.1, 0.9, 0.05)}),
    "h_wave": ("Wave", _ALL[:3], {"period_ms": (1200, 200, 4000, 100), "depth": (0.7, 0, 1, 0.05)}),
    "h_rolling": ("Rolling", _BODY, {"period_ms": (1800, 400, 6000, 100), "depth": (0.6, 0, 1, 0.05), "direction": None}),
    "h_tremor": ("Tremor", _ALL, {"rate": (0.5, 0, 1, 0.01), "depth": (0.4, 0, 1, 0.01), "seed": (42, 0, 999, 1)}),
    "h_sustain": ("Sustain", _ALL, {"depth": (0.5, 0, 1, 0.01), "warmup_ms": (800, 0, 5000, 100)}),
    "h_impact": ("Impact", _ALL, {"every_ms": (4000, 500, 30000, 100), "depth": (0.9, 0, 1, 0.01), "decay_ms": (250, 50, 1000, 10)}),
    "h_reactive": ("Reactive", _ALL, {"gain": (1.0, 0, 2, 0.05), "floor": (0.0, 0, 1, 0.05), "attack_ms": (30, 5, 500, 5), "release_ms": (250, 50, 2000, 10), "source": None}),
}
CONSUMERS = {"haptic": "Haptics", "stim": "Stim", "multiaxis": "Multi-axis", "edit": "Edit"}
NO_PATTERN = "_none"
DETECTORS = {"content": (27.0, 5.0, 100.0), "threshold": (12.0, 1.0, 255.0), "adaptive": (3.0, 1.0, 10.0)}


def patterns(spark: SparkSession) -> DataFrame:
    """One row per pattern and parameter; the sentinel has none."""
    rows = [(k, label, list(where), list(CONSUMERS), p, *(map(float, v) if v else (None,) * 4)) for k, (label, where, params) in PATTERNS.items() for p, v in params.items()]
    return spark.createDataFrame([*rows, (NO_PATTERN, "None", [], [], None, None, None, None, None)], "id string, label string, topology array<string>, consumers array<string>, param string, default_value double, least double, most double, step double")


def is_pattern(pattern: Column) -> Column:
    return pattern.isin(*PATTERNS, NO_PATTERN)


def detectors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in DETECTORS.items()], "detector string, threshold_default double, threshold_min double, threshold_max double")
