"""Command line: run a named query or a document command over files; JSON by default, --human for a table.

Exit codes: 0 done, 1 error, 2 not built (commands that need a media encoder).
"""

from __future__ import annotations

import argparse
import json
import sys

NOT_BUILT = ("render", "concat", "chapters-embed")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoloom", description=__doc__)
    p.add_argument("--human", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="a query of the catalog")
    q.add_argument("name")
    q.add_argument("tables", help="folder of parquet tables")
    q.add_argument("--out", help="write parquet there instead of printing")
    sub.add_parser("patterns-list")
    sub.add_parser("detectors")
    s = sub.add_parser("detect-scenes", help="scores parquet (track_id, frame_idx, score)")
    s.add_argument("scores")
    s.add_argument("--detector", default="adaptive")
    s.add_argument("--threshold", type=float)
    a = sub.add_parser("analyze-beats", help="WAVE files")
    a.add_argument("media")
    a.add_argument("--source", default="full")
    a.add_argument("--tracker", default="auto")
    a.add_argument("--locked-bpm", type=float)
    c = sub.add_parser("auto-chapter", help="WAVE files")
    c.add_argument("media")
    c.add_argument("--target-minutes", type=float, default=5.5)
    g = sub.add_parser("generate-curve", help="beats parquet (track_id, seq, at_ms, energy)")
    g.add_argument("beats")
    g.add_argument("--low", type=int, default=10)
    g.add_argument("--high", type=int, default=90)
    g.add_argument("--center", type=int)
    g.add_argument("--energy-normalize", action="store_true")
    g.add_argument("--stroke-density", default="half")
    g.add_argument("--tone", default="flat", choices=["flat", "rise", "fall", "auto"])
    g.add_argument("--density-arc", default="default", choices=["default", "none"])
    g.add_argument("--title", default="")
    g.add_argument("--center-trajectory", help="two centres, as 30,70: from the first beat to the last")
    g.add_argument("--bundle", help="folder of recipe bundles (JSON; track_id in a column of its own), one curve per chapter")
    y = sub.add_parser("chapters-to-youtube-description", help="chapters parquet (track_id, seq, at_ms, name, intent)")
    y.add_argument("chapters")
    y.add_argument("--sources", action="store_true", help="chapters are (track_id, priority, source, chapters): the first source counts")
    m = sub.add_parser("chapters-write-sidecar", help="records parquet (track_id, ord, fields): existing, incoming")
    m.add_argument("existing")
    m.add_argument("incoming")
    m.add_argument("--mode", default="edit", choices=["edit", "analyze"])
    for name in NOT_BUILT:
        sub.add_parser(name)
    return p


#: What the records of a track are sorted by.
ORDER = ("chapter_idx", "stanza_idx", "seq")


def plan(spark, a):
    """The DataFrame that a command shows."""
    from pyspark.sql import functions as F

    from chronoloom.operators import curve, documents, merge, shell, structure, timeline
    from chronoloom.plans import catalog

    if a.command == "query":
        return catalog.QUERIES[a.name](spark, a.tables)
    if a.command in ("patterns-list", "detectors"):
        return shell.patterns(spark) if a.command == "patterns-list" else shell.detectors(spark)
    if a.command == "detect-scenes":
        return structure.scene_cuts(spark.read.parquet(a.scores), a.detector, a.threshold)
    if a.command in ("analyze-beats", "auto-chapter"):
        from chronoloom.dsp import plans as dsp

        from chronoloom.plans import composites

        samples = dsp.read_samples(spark.read.format("binaryFile").load(a.media))
        if a.command == "analyze-beats":
            return composites.analyse_beats(samples, tracker=a.tracker, locked_bpm=a.locked_bpm, source=a.source)
        run = composites.auto_chapter(samples.persist(), target_minutes=a.target_minutes)
        out = samples.where("data is not null").select("track_id").distinct()
        for name in ("chapters", "beats", "stanzas", "energy"):
            part = getattr(run, name)
            columns = sorted((c for c in part.columns if c != "track_id"), key=lambda c: c not in ORDER)
            rows = F.array_sort(F.collect_list(F.struct(*columns)))
            out = out.join(part.groupBy("track_id").agg(rows.alias(name)), "track_id", "left")
        return out
    if a.command == "generate-curve":
        beats = spark.read.parquet(a.beats)
        knobs = {"low": a.low, "high": a.high, "center": a.center, "energy_normalize": a.energy_normalize, "stroke_density": a.stroke_density}
        if a.tone in ("rise", "fall"):
            knobs["center_trajectory"] = (30, 70) if a.tone == "rise" else (70, 30)
        elif a.tone == "auto":
            knobs["tone"] = curve.auto_tone(beats, timeline.stanzas(beats))
        elif a.center_trajectory:
            knobs["center_trajectory"] = tuple(int(x) for x in a.center_trajectory.split(","))
        if a.bundle:
            return bundle_curves(spark, beats, a.bundle)
        return documents.curve_documents(curve.generate(beats, density_arc_default=a.density_arc == "default", **knobs), title=a.title)
    if a.command == "chapters-to-youtube-description":
        chapters = spark.read.parquet(a.chapters)
        if a.sources:
            from chronoloom.sources.timeline import resolve_chapters

            rows = resolve_chapters(chapters).select("track_id", F.posexplode("chapters").alias("seq", "c"))
            chapters = rows.select("track_id", "seq", "c.at_ms", "c.end_ms", "c.name", "c.intent")
        return documents.youtube_block(chapters)
    incoming = spark.read.parquet(a.incoming)
    if a.mode == "edit":  # an author's chapters: later analyses leave them alone
        latch = F.create_map(F.lit("auto_generated"), F.lit("false"))
        incoming = incoming.withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: k != "auto_generated"), latch))
    return merge.merge_records(spark.read.parquet(a.existing), incoming, merge.CHAPTER, a.mode)


def bundle_curves(spark, beats, folder):
    """Curves of recipe bundles: ``folder`` holds parquet (track_id, doc); every chapter has its own recipe."""
    from pyspark.sql import functions as F

    from chronoloom.operators import curve
    from chronoloom.sources.timeline import recipe_bundles

    rows = recipe_bundles(spark.read.parquet(folder)).persist()
    if wrong := rows.where("mismatched").select("track_id").first():
        raise ValueError(f"chapters and recipes differ in number: track {wrong.track_id}")
    kinds = [(r.stroke_density or "half", r.tone or "") for r in rows.select("stroke_density", "tone").distinct().orderBy("stroke_density", "tone").collect()]
    tones = {"rise": {"center_trajectory": (30, 70)}, "fall": {"center_trajectory": (70, 30)}}
    knobs = [{"stroke_density": density, **tones.get(tone, {})} for density, tone in kinds]
    of = F.array_position(F.array(*[F.lit("|".join(k)) for k in kinds]), F.concat_ws("|", F.coalesce("stroke_density", F.lit("half")), F.coalesce("tone", F.lit("")))) - 1
    recipes = rows.select("track_id", "chapter_idx", of.cast("int").alias("recipe"))
    return curve.generate_per_chapter(beats, rows.select("track_id", "chapter_idx", "at_ms", "end_ms"), knobs, recipes)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in NOT_BUILT:
        print(json.dumps({"error": f"{a.command} needs a media encoder"}), file=sys.stderr)
        return 2
    try:
        from pyspark.sql import SparkSession

        df = plan(SparkSession.builder.getOrCreate(), a)
        if getattr(a, "out", None):
            df.write.parquet(a.out)
        elif a.human:
            df.show(truncate=False)
        else:
            for row in df.toJSON().toLocalIterator():
                print(row)
    except Exception as e:  # noqa: BLE001 - the command's error is its result
        print(json.dumps({"error": str(e).splitlines()[0]}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
