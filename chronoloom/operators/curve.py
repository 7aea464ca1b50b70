"""From beats to a motion curve: density arcs, strokes, tone, shaping, export."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK, clamp, half_even, rank_a, with_ranks

from . import modes as mode_rules
from . import tempo, timeline

DENSITY = {"half": 1, "full": 2, "1": 1, "2": 2, "4": 4, "8": 8}
HIGH_SCALE = {"break": 0.12, "tease": 0.38, "slow": 0.95, "steady": 0.78, "fast": 0.7, "edging": 1.0}
DEPTH = {"break": 0.55, "tease": 0.72, "slow": 0.95, "steady": 1.0, "fast": 0.5, "edging": 1.0}
STROKES = {"break": 2, "tease": 2, "slow": 2, "steady": 2, "fast": 4, "edging": 6}
ARC_FULL = 0.45


def resolve_density(value: str | int) -> int:
    if str(value) not in DENSITY or isinstance(value, (float, bool)):
        raise ValueError(f"stroke density must be one of {sorted(DENSITY)}, not {value!r}")
    return DENSITY[str(value)]


def _lookup(values: dict, key: Column, default: float | int) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def track_position(beats: DataFrame) -> DataFrame:
    """position: 0 at the track's first beat, 1 at its last; 0 where they are one."""
    w = Window.partitionBy(TRACK)
    span = F.max("at_ms").over(w) - F.min("at_ms").over(w)
    return beats.withColumn("position", (F.col("at_ms") - F.min("at_ms").over(w)) / F.when(span == 0, F.lit(1)).otherwise(span))


def arc_curve(position: Column, *, build=0.08, taper=0.12, base=0.5, peak=0.72, peak_at=0.85, climax_width=0.18, floor=0.0) -> Column:
    """A narrative arc: a ramp, a flat body with a triangular climax, a comedown."""
    p = clamp(position, 0.0, 1.0)
    cw = max(0.0, climax_width) / 2
    body = F.lit(base)
    if cw > 0:
        body = F.when((p >= peak_at - cw) & (p <= peak_at + cw), base + (peak - base) * (1.0 - F.abs(p - peak_at) / cw)).otherwise(body)
    down = floor + (base - floor) * ((1.0 - p) / taper) if taper > 0 else F.lit(floor)
    up = floor + (base - floor) * (p / build) if build > 0 else F.lit(base)
    return clamp(F.when(p < build, up).when(p > 1.0 - taper, down).otherwise(body), 0.0, 1.0)


def density_arc(beats: DataFrame, **knobs: float) -> DataFrame:
    return track_position(beats).withColumn("arc", arc_curve(F.col("position"), **knobs)).drop("position")


def density_arc_from_levels(beats: DataFrame, levels: DataFrame, default: float = 0.55) -> DataFrame:
    """arc: the level of the first of ``levels(track_id, span_idx, start_ms, end_ms, level)`` that holds the beat."""
    points = beats.withColumn("point_id", F.col("seq"))
    out = timeline.containing(points, levels, F.col("at_ms"), ["level"], last=False)
    return out.withColumn("arc", clamp(F.coalesce("level", F.lit(default)), 0.0, 1.0)).drop("level", "span_idx", "point_id")


def arc_strokes(arc: Column, ceil: int = 6) -> Column:
    """An even number of strokes: 2 up to 0.45, then rising to the ceiling."""
    return F.when(arc <= ARC_FULL, 2).otherwise(2 + 2 * half_even(F.least(F.lit(1.0), (arc - ARC_FULL) / 0.55) * (ceil // 2 - 1))).cast("int")


def fired(beats: DataFrame) -> DataFrame:
    """Beats (with arc) that fire: an accumulator gains min(1, arc / 0.45) a beat and gives 1 whenever it has it.

    The state depends on every earlier beat's rounding, so no window sum gives it: each track's beats pass in order
    through one running number, a batch at a time, however many they are. Null arc: a whole gain.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, acc = object(), 0.0
        for b in batches:
            keep = []
            for own, arc in zip(b.column(key).to_pylist(), b.column(value).to_pylist()):
                if own != track:
                    track, acc = own, 0.0
                acc += 1.0 if arc is None else min(1.0, arc / ARC_FULL)
                keep.append(acc >= 1)
                if acc >= 1:
                    acc -= 1
            yield b.filter(pa.array(keep, pa.bool_()))

    key, value = beats.columns.index(TRACK), beats.columns.index("arc")
    return beats.repartition(TRACK).sortWithinPartitions(TRACK, "seq").mapInArrow(run, beats.schema)


def auto_tone(beats: DataFrame, spans: DataFrame, baseline: int = 50, swing: int = 20) -> DataFrame:
    """Centres that rise or fall with each stanza's energy: the least-squares rise over the stanza, at most 1."""
    w = Window.partitionBy(TRACK, "stanza_idx")
    b = mode_rules.in_stanzas(beats, spans).select(TRACK, "stanza_idx", "energy", (F.row_number().over(w.orderBy("seq")) - 1).alias("i"))
    g = b.groupBy(TRACK, "stanza_idx").agg(F.count("*").alias("n"), F.sum("energy").alias("se"), F.sum(F.col("i") * F.col("energy")).alias("sie"))
    # sums of (i - mean)(e - mean) and (i - mean)**2, from exact sums
    num = F.col("sie") - (F.col("n") - 1) / F.lit(2.0) * F.col("se")
    den = F.col("n") * (F.col("n") * F.col("n") - 1) / F.lit(12.0)
    rise = clamp(num / den * (F.col("n") - 1), -1.0, 1.0)
    delta = F.when(F.col("n") >= 2, half_even(rise * swing / 2)).otherwise(0)
    out = spans.join(g, [TRACK, "stanza_idx"], "left").withColumn("delta", F.coalesce(delta, F.lit(0)).cast("int"))
    return out.select(TRACK, "stanza_idx", "start_ms", "end_ms", (F.lit(baseline) - F.col("delta")).alias("start_center"), (F.lit(baseline) + F.col("delta")).alias("end_center"))


def _centre(points: DataFrame, *, center: int | None, trajectory: tuple[int, int] | None, tone: DataFrame | None) -> DataFrame:
    """Adds center (null if there is none): a stanza's own tone, else a line over the track, else a constant."""
    if tone is not None:
        spans = tone.withColumnRenamed("stanza_idx", "span_idx").select(TRACK, "span_idx", "start_ms", "end_ms", "start_center", "end_center", F.col("start_ms").alias("ps"), F.col("end_ms").alias("pe"))
        p = timeline.tiled(points, spans, F.col("at_ms"), ["ps", "pe", "start_center", "end_center"], last=True)
        inside = (F.col("at_ms") >= F.col("ps")) & (F.col("at_ms") < F.col("pe"))
        progress = clamp((F.col("at_ms") - F.col("ps")) / F.greatest(F.lit(1), F.col("pe") - F.col("ps")), 0.0, 1.0)
        c = F.when(inside, half_even(F.col("start_center") + (F.col("end_center") - F.col("start_center")) * progress)).otherwise(F.col("end_center"))
        return p.withColumn("center", c.cast("int")).drop("span_idx", "ps", "pe", "start_center", "end_center")
    if trajectory is not None:
        a, b = trajectory
        progress = clamp((F.col("at_ms") - F.col("t0")) / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)), 0.0, 1.0)
        return points.withColumn("center", half_even(a + (b - a) * progress).cast("int"))
    return points.withColumn("center", F.lit(center).cast("int"))


def beats_to_curve(
    beats: DataFrame, *, low: int = 10, high: int = 90, min_stroke: int = 20, center: int | None = None, center_trajectory: tuple[int, int] | None = None, tone: DataFrame | None = None,
    energy_normalize: bool = False, stroke_density: str | int = "half", depth_model: str = "fixed", gate: float = 0.1, modes: DataFrame | None = None, arc: bool = False, density_ceil: int = 6,
    gain: bool = False, texture: float = 0.0,
) -> DataFrame:
    """Points (track_id, seq, k, at_ms, pos) of a curve; ``beats`` may carry columns arc and gain for those knobs.

    fixed: each fired beat makes a full stroke; modes set its depth, energy only whether it fires (or, within
    ``texture``, how far quiet beats are drawn in). energy: depth follows energy, about a centre or up from low.
    modes: ``(track_id, stanza_idx, start_ms, end_ms, mode)``; beats in no stanza take the last one's.
    """
    n = resolve_density(stroke_density)
    b = timeline.next_durations(tempo.p95_normalised(beats))
    track = Window.partitionBy(TRACK)
    b = b.withColumns({"t0": F.min("at_ms").over(track), "t1": F.max("at_ms").over(track)})
    centred = center is not None or center_trajectory is not None or tone is not None
    centre = {"center": center, "trajectory": center_trajectory, "tone": tone}
    if depth_model == "fixed":
        if modes is not None:
            spans = modes.withColumnRenamed("stanza_idx", "span_idx").select(TRACK, "span_idx", "start_ms", "end_ms", "mode")
            b = timeline.tiled(b, spans, F.col("at_ms"), ["mode"], last=True).drop("span_idx")
            b = b.withColumn("mode", F.coalesce("mode", F.lit("steady")))
        else:
            b = b.withColumn("mode", F.lit("steady"))
        half = 50.0 * _lookup(DEPTH, F.col("mode"), 1.0)
        if gain:
            half = half * F.coalesce(clamp(F.col("gain"), 0.0, 1.0), F.lit(1.0))
        if texture > 0:
            b = with_ranks(b, [TRACK], "norm", {"lo": (lambda n, q: F.floor(n * F.lit(q)), 0.1), "hi": (rank_a, 0.9)})
            span = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise(F.col("hi") - F.col("lo"))
            half = half * (1.0 - F.lit(float(texture)) * (1.0 - clamp((F.col("norm") - F.col("lo")) / span, 0.0, 1.0)))
        b = b.withColumn("half", half)
        b = fired(b).withColumn("density", arc_strokes(F.col("arc"), density_ceil)) if arc else b.where(F.col("norm") >= gate).withColumn("density", _lookup(STROKES, F.col("mode"), 2))
        b = b.withColumn("n", F.greatest(F.lit(2), F.lit(n), F.col("density")).cast("int"))
        each = b.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
        each = each.withColumn("at_ms", F.col("at_ms") + F.floor(F.col("k") * F.col("dur_ms") / F.col("n")).cast("long"))
        each = _centre(each.withColumn("point_id", F.col("seq").cast("long") * 64 + F.col("k")), **centre) if centred else each.withColumn("center", F.lit(50))
        pos = clamp(half_even(F.when(F.col("k") % 2 == 0, F.col("center") + F.col("half")).otherwise(F.col("center") - F.col("half"))))
        return each.select(TRACK, "seq", "k", "at_ms", pos.cast("int").alias("pos"))
    e = F.col("norm") if energy_normalize else F.col("energy")
    b = b.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    b = b.withColumn("at_ms", F.col("at_ms") + F.floor(F.col("k") * F.col("dur_ms") / n).cast("long"))
    up = (F.col("seq") if n == 1 else F.col("k")) % 2 == 0
    if centred:
        b = _centre(b.withColumn("point_id", F.col("seq").cast("long") * 64 + F.col("k")), **centre)
        half = F.greatest(F.lit(min_stroke / 2), F.lit((high - low) / 2) * e)
        pos = F.when(up, F.least(F.lit(100), half_even(F.col("center") + half))).otherwise(F.greatest(F.lit(0), half_even(F.col("center") - half)))
    else:
        pos = F.when(up, F.least(F.lit(100), low + F.greatest(F.lit(min_stroke), half_even((high - low) * e)))).otherwise(low)
    return b.select(TRACK, "seq", "k", "at_ms", pos.cast("int").alias("pos"))


def shape_curve(curve: DataFrame, modes: DataFrame, *, low: int = 10, center: int | None = None, center_trajectory: tuple[int, int] | None = None, tone: DataFrame | None = None) -> DataFrame:
    """Scale each point by its stanza's mode, towards its centre, or peaks towards low; edging grows over its stanza."""
    track = Window.partitionBy(TRACK)
    c = curve.withColumns({"t0": F.min("at_ms").over(track), "t1": F.max("at_ms").over(track), "point_id": F.col("seq").cast("long") * 64 + F.col("k")})
    spans = modes.select(TRACK, F.col("stanza_idx").alias("span_idx"), "start_ms", "end_ms", "mode", F.col("start_ms").alias("ss"), F.col("end_ms").alias("se"))
    c = timeline.tiled(c, spans, F.col("at_ms"), ["mode", "ss", "se"], last=True).drop("span_idx")
    grow = 0.5 + 0.5 * F.least(F.lit(1.0), (F.col("at_ms") - F.col("ss")) / F.greatest(F.lit(1), F.col("se") - F.col("ss")))
    c = c.withColumn("scale", F.when(F.col("mode") == "edging", grow).otherwise(_lookup(HIGH_SCALE, F.col("mode"), HIGH_SCALE["steady"])))
    c = _centre(c, center=center, trajectory=center_trajectory, tone=tone)
    p, m = F.col("pos"), F.col("center")
    about = clamp(half_even(m + (p - m) * F.col("scale")))
    above = F.when(p <= low, p).otherwise(clamp(low + half_even((p - low) * F.col("scale"))))
    return c.select(TRACK, "seq", "k", "at_ms", F.when(m.isNotNull(), about).otherwise(above).cast("int").alias("pos"))


def export_points(curve: DataFrame) -> DataFrame:
    """One point per time, the lowest; clamped."""
    return curve.groupBy(TRACK, "at_ms").agg(F.min("pos").alias("pos")).select(TRACK, "at_ms", clamp(F.col("pos")).cast("int").alias("pos"))


def generate(beats: DataFrame, *, density_arc_default: bool = True, **knobs) -> DataFrame:
    """Classify, arc, curve, (for the energy model) shape, export."""
    spans = timeline.stanzas(beats)
    modes = mode_rules.modes_whole(beats, spans)
    if knobs.get("depth_model", "fixed") != "fixed":
        about = {k: knobs[k] for k in ("low", "center", "center_trajectory", "tone") if k in knobs}
        return export_points(shape_curve(beats_to_curve(beats, **knobs), modes, **about))
    return export_points(beats_to_curve(density_arc(beats) if density_arc_default else beats, modes=modes, arc=density_arc_default, **knobs))


def pair_recipes(chapters: DataFrame, recipes: DataFrame) -> DataFrame:
    """``chapters`` with the recipe of ``recipes(track_id, chapter_idx, recipe)`` for each: a strict zip.

    A track with a chapter that has no recipe, or a recipe without its chapter, fails the query.
    """
    r = recipes.select(TRACK, "chapter_idx", F.coalesce("recipe", F.lit(-1)).alias("recipe"))
    both = chapters.withColumn("here", F.lit(True)).join(r, [TRACK, "chapter_idx"], "full")
    wrong = F.col("here").isNull() | F.col("recipe").isNull()
    message = F.concat(F.lit("chapters and recipes differ in number: track "), F.to_json(F.struct(TRACK, "chapter_idx")))
    return both.withColumn("recipe", F.when(wrong, F.raise_error(message).cast("int")).otherwise(F.col("recipe"))).where("recipe is not null").drop("here")


def generate_per_chapter(beats: DataFrame, chapters: DataFrame, knobs: list[dict] | None = None, recipes: DataFrame | None = None) -> DataFrame:
    """A curve for each chapter on its own beats (``chapters(track_id, chapter_idx, at_ms, end_ms)``), all in one result.

    knobs: the settings that recipes name by their place; ``recipes(track_id, chapter_idx, recipe)`` pairs every chapter
    with one (see ``pair_recipes``); none: the defaults. Each chapter is a track of its own meanwhile, so percentiles and
    modes are the chapter's.
    """
    if (knobs is None) != (recipes is None):
        raise ValueError("knobs and recipes go together")
    chapters = chapters.withColumn("recipe", F.lit(0)) if recipes is None else pair_recipes(chapters, recipes)
    ch = chapters.select(F.col(TRACK).alias("__t"), "chapter_idx", "recipe", F.col("at_ms").alias("__s"), F.coalesce("end_ms", F.lit(1 << 62)).alias("__e"))
    own = beats.join(ch, (beats[TRACK] == ch["__t"]) & (F.col("at_ms") >= F.col("__s")) & (F.col("at_ms") < F.col("__e"))).drop("__t", "__s", "__e")
    first = F.min("seq").over(Window.partitionBy(TRACK, "chapter_idx"))
    own = own.withColumn("seq", (F.col("seq") - first).cast("int")).withColumn(TRACK, F.struct(TRACK, "chapter_idx")).drop("chapter_idx")
    out = None
    for i, settings in enumerate(knobs or [{}]):
        part = generate(own.where(F.col("recipe") == i).drop("recipe"), density_arc_default=False, **settings)
        out = part if out is None else out.unionByName(part)
    return out.select(F.col(f"{TRACK}.{TRACK}").alias(TRACK), F.col(f"{TRACK}.chapter_idx").alias("chapter_idx"), "at_ms", "pos")
