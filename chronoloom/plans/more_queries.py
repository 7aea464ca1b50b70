"""Queries of document sources and sinks, the document merge and the shell's text rules, with their SQL.

Documents are made from the event table's tracks here, and told apart again by the operators; the SQL says what must come
out, from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK
from chronoloom.operators import merge, shell
from chronoloom.sources import sinks
from chronoloom.sources import timeline as sources

from . import catalog
from .catalog import CTE, SILENCE, _beats, _cache_lookup, _chunks, _files

BEATS_CHUNKS = f"with {CTE['beats']}, {CTE['chunks']}"
TRACKS = f"with {CTE['beats']}, t as (select distinct track_id from beats)"


def _add(name: str, sql: str, f) -> None:
    catalog.QUERIES[name], catalog.ORACLE_SQL[name] = f, sql


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    return _beats(spark, d).select(TRACK).distinct()


_add(
    "chapter_cuts",
    f"""with recursive {CTE["beats"]}, {CTE["chunks"]}, centres as ({SILENCE}), bounds as (select distinct track_id, end_ms / 1000 as x from chunks),
    snapped as (select b.track_id, case when abs(n.c - b.x) <= 8 then n.c else b.x end as s from bounds b left join (
        select b.track_id, b.x, arg_min(c.centre, (abs(c.centre - b.x), c.centre)) as c from bounds b join centres c using (track_id) group by all) n using (track_id, x)),
    ends as (select track_id, max(at_ms) / 1000 as d from beats group by track_id),
    cuts as (select distinct track_id, cut from (select track_id, 0e0 as cut from ends union all select track_id, d from ends union all select track_id, least(s, d) from snapped join ends using (track_id))),
    {CTE["kept"].replace(">= 3", ">= 4")}, {CTE["micro"].replace("lastkept < 3", "lastkept < 4")}
    select track_id, cut from (with g as (select *, cut - b as gap, case when cut - b > 15 then cast(floor((cut - b) / 15) as int) + 1 else 1 end as n from (select *, lag(cut) over (partition by track_id order by cut) as b from micro))
        select track_id, cut from g union all select track_id, b + k * (gap / n) from (select *, unnest(range(1, n)) as k from g))""",
    catalog.QUERIES["chapter_cuts"],
)


def _merged_documents(spark: SparkSession, d: str, mode: str) -> DataFrame:
    t = F.col(TRACK)
    tracks, none = _tracks(spark, d), F.lit(None).cast("string")
    text = lambda c: c.cast("string")
    old = tracks.where(t % 2 == 0).select(
        TRACK, F.when(t % 4 != 0, "old").alias("schema"), F.when(t % 4 != 0, "2.0").alias("version"), F.lit("0").alias("analyzer_version"), (t % 8 != 0).alias("auto_generated"), F.lit("first").alias("generated_by"),
        F.when(t % 6 != 0, '{"a":1}').alias("energy"), F.create_map(F.lit("vendor"), text(t), F.lit("keep"), F.lit("k")).alias("extras"),
    )
    new = tracks.where(t % 3 != 1).select(TRACK, none.alias("schema"), none.alias("version"), none.alias("analyzer_version"), F.when(t % 7 == 0, False).alias("auto_generated"), F.lit("second").alias("generated_by"), F.when(t % 5 == 0, '{"b":2}').alias("energy"), F.create_map(F.lit("vendor"), F.lit("new")).alias("extras"))
    return merge.merge_documents(old, new, mode).select("*", F.col("extras")["vendor"].alias("vendor"), F.col("extras")["keep"].alias("keep")).drop("extras")


MERGED = (
    TRACKS
    + """ select track_id, case when n then 'timeline' when track_id % 4 <> 0 then 'old' else 'timeline' end as schema, case when n then '3.0' when track_id % 4 <> 0 then '2.0' else '1.0' end as version,
    {analyzer} as analyzer_version, case when not o then coalesce(case when track_id % 7 = 0 then false end, true) when n and {edit} then false else track_id % 8 <> 0 end as auto_generated, case when o then 'first' else 'second' end as generated_by,
    coalesce(case when n and track_id % 5 = 0 then '{{"b":2}}' end, case when o and track_id % 6 <> 0 then '{{"a":1}}' end) as energy, case when n then 'new' else cast(track_id as varchar) end as vendor, case when o then 'k' end as keep
    from (select track_id, track_id % 2 = 0 as o, track_id % 3 <> 1 as n from t) where o or n"""
)
_add("merge_documents_analyze", MERGED.format(edit="false", analyzer="case when n then '1' when o then '0' end"), lambda spark, d: _merged_documents(spark, d, "analyze"))
_add("merge_documents_edit", MERGED.format(edit="true", analyzer="case when o then '0' end"), lambda spark, d: _merged_documents(spark, d, "edit"))


def _chapter_lists(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """Each track's chunks as a JSON list of chapters; ``more`` fields are made of chunk_idx."""
    item = F.struct("chunk_idx", F.struct("at_ms", "end_ms", *more).alias("c"))
    return _chunks(_beats(spark, d)).groupBy(TRACK).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])).alias("list"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of every age and some broken ones, by the track's number."""
    tone = F.when(F.col("chunk_idx") % 2 == 0, "none").otherwise("rise").alias("tone")
    own = F.when(F.col("chunk_idx") == 1, "true").alias("auto_generated")
    t, one = F.col(TRACK) % 6, lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    lists = _chapter_lists(spark, d, tone, own)
    doc = (
        F.when(t == 0, F.concat(F.lit("\n "), F.col("list"))).when(t == 1, one('{"version":"1.0","auto_generated":false,"vendor":{"x":1},"chapters":', F.col("list"), "}"))
        .when(t == 2, one('{"chapters":[],"stanzas":', F.col("list"), "}")).when(t == 3, '{"chapters":{"at_ms":0}}').when(t == 4, '"text"').otherwise(one('{"schema":"s","version":"3.0","energy":{"p5":0},"chapters":', F.col("list"), "}"))
    )
    return lists.select(TRACK, doc.alias("doc"))


def _document_records(spark: SparkSession, d: str) -> DataFrame:
    r = merge.read_documents(_documents(spark, d))[1]
    return r.select(TRACK, "kind", "ord", *[F.col("fields")[k].alias(k) for k in ("at_ms", "end_ms", "tone", "auto_generated")])


_add(
    "document_records",
    BEATS_CHUNKS + """ select track_id, case when track_id % 6 = 2 then 'stanza' else 'chapter' end as kind, chunk_idx as ord, cast(at_ms as varchar) as at_ms, cast(end_ms as varchar) as end_ms, case when chunk_idx % 2 = 0 then '' else 'rise' end as tone,
    case when chunk_idx = 1 then 'true' when track_id % 6 = 1 then 'false' end as auto_generated from chunks where track_id % 6 in (0, 1, 2, 5)""",
    _document_records,
)
_add(
    "document_headers",
    TRACKS + """ select track_id, case when track_id % 6 = 5 then 's' else 'timeline' end as schema, case when track_id % 6 = 5 then '3.0' else '1.0' end as version, case when track_id % 6 = 1 then false end as auto_generated,
    case when track_id % 6 = 5 then '{"p5":0}' end as energy, case when track_id % 6 = 1 then '{"x":1}' end as vendor from t where track_id % 6 in (0, 1, 2, 5)""",
    lambda spark, d: merge.read_documents(_documents(spark, d))[0].select(TRACK, "schema", "version", "auto_generated", "energy", F.col("extras")["vendor"].alias("vendor")),
)
_add("document_rejects", TRACKS + " select track_id, case when track_id % 6 = 3 then '''chapters'' must be a list' else 'not a JSON object or list' end as error from t where track_id % 6 in (3, 4)", lambda spark, d: merge.read_documents(_documents(spark, d))[2])


def _typed_chapters(spark: SparkSession, d: str) -> DataFrame:
    texture = F.when(F.col("chunk_idx") % 3 == 0, "music").when(F.col("chunk_idx") % 3 == 1, "ambient").otherwise("calm").alias("content_type")
    lists = _chapter_lists(spark, d, texture, F.when(F.col("chunk_idx") % 2 == 0, "").alias("intent"), F.lit("plan").alias("intent_proposal"))
    return sources.document_chapters(lists.select(TRACK, F.when(F.col(TRACK) % 2 == 0, F.col("list")).otherwise(F.concat(F.lit('{"chapters":'), "list", F.lit("}"))).alias("doc"))).select(TRACK, "idx", "at_ms", "end_ms", "intent", "content_type")


_add("document_chapters", BEATS_CHUNKS + " select track_id, chunk_idx as idx, at_ms, end_ms, 'plan' as intent, case chunk_idx % 3 when 0 then 'driving' else 'calm' end as content_type from chunks", _typed_chapters)


def _analysis(spark: SparkSession, d: str) -> DataFrame:
    """Confirmed chapters where a track has some, else its proposals, which spell their fields in another way."""
    good = _chapter_lists(spark, d).select(TRACK, F.col("list").alias("good"))
    proposals = _chunks(_beats(spark, d)).groupBy(TRACK).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col("at_ms").alias("start_ms"), "end_ms"))), lambda x: F.struct((x["start_ms"] + 1).alias("start_ms"), x["end_ms"].alias("end_ms"), F.lit("guess").alias("intent_proposal")))).alias("other"))
    doc = F.concat(F.lit('{"metadata":{"chapters":'), F.when(F.col(TRACK) % 3 == 0, F.lit("[]")).otherwise(F.col("good")), F.lit('},"chapter_proposals":'), "other", F.lit("}"))
    return sources.analysis_chapters(good.join(proposals, TRACK).select(TRACK, doc.alias("doc"))).select(TRACK, "idx", "at_ms", "end_ms", "intent")


_add("analysis_chapters", BEATS_CHUNKS + " select track_id, chunk_idx as idx, at_ms + case when track_id % 3 = 0 then 1 else 0 end as at_ms, end_ms, case when track_id % 3 = 0 then 'guess' else '' end as intent from chunks", _analysis)


def _probe(spark: SparkSession, d: str) -> DataFrame:
    secs = lambda c: F.format_string("%.4f", F.col(c) / 1000 + F.lit(0.0004))
    item = F.struct("chunk_idx", F.struct(F.when((F.col("chunk_idx") != 1) | (F.col(TRACK) % 2 == 0), secs("at_ms")).otherwise("N/A").alias("start_time"), secs("end_ms").alias("end_time"), F.when(F.col("chunk_idx") != 0, F.struct(F.concat(F.lit("c"), "chunk_idx").alias("title"))).alias("tags")).alias("c"))
    docs = _chunks(_beats(spark, d)).groupBy(TRACK).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"]).alias("chapters"))).alias("probe"))
    return sources.probe_chapters(docs)


_add("probe_chapters", BEATS_CHUNKS + " select track_id, chunk_idx as idx, at_ms, end_ms, case when chunk_idx = 0 then '' else 'c' || chunk_idx end as name from chunks where chunk_idx <> 1 or track_id % 2 = 0", _probe)
_add("normalise_actions", f"with {CTE['beats']} select track_id, seq, at_ms, energy, cast(greatest(0, least(100, pos * 3 - 100)) as int) as pos from beats", lambda spark, d: sources.normalise_actions(_beats(spark, d).withColumn("pos", F.col("pos") * 3 - 100)))


def _stanza_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stanza documents of chunks, some without a field that they need."""
    fields = F.struct(F.col("chunk_idx").alias("chapter_idx"), F.when(F.col("chunk_idx") != 1, F.col("at_ms")).alias("at_ms"), "end_ms", F.when(F.col(TRACK) % 5 != 0, "slow").alias("mode"), F.when(F.col("chunk_idx") == 2, False).alias("auto_generated"))
    return sources.parse_stanzas(_chunks(_beats(spark, d)).select(TRACK, F.to_json(fields).alias("doc"))).select(TRACK, "chapter_idx", "at_ms", "end_ms", "mode", "tone", "auto_generated", "rejected")


_add("stanza_documents", BEATS_CHUNKS + " select track_id, chunk_idx as chapter_idx, case when chunk_idx <> 1 then at_ms end as at_ms, end_ms, case when track_id % 5 <> 0 then 'slow' end as mode, '' as tone, chunk_idx <> 2 as auto_generated, chunk_idx = 1 or track_id % 5 = 0 as rejected from chunks", _stanza_rows)


def _bundles(spark: SparkSession, d: str) -> DataFrame:
    recipe = F.struct("chunk_idx", F.struct(F.when(F.col("chunk_idx") % 2 == 0, "half").otherwise("4").alias("stroke_density"), F.lit("rise").alias("tone"), (F.col("chunk_idx") / 8).alias("intensity")).alias("r"))
    recipes = _chunks(_beats(spark, d)).groupBy(TRACK).agg(F.transform(F.array_sort(F.collect_list(recipe)), lambda x: x["r"]).alias("r"))
    recipes = recipes.select(TRACK, F.to_json(F.when(F.col(TRACK) % 4 == 0, F.slice("r", 1, 1)).otherwise(F.col("r"))).alias("r"))
    docs = _chapter_lists(spark, d).join(recipes, TRACK).select(TRACK, F.concat(F.lit('{"chapters":'), "list", F.lit(',"recipes":'), "r", F.lit("}")).alias("doc"))
    return sources.recipe_bundles(docs).select(TRACK, "mismatched", "chapter_idx", "at_ms", "end_ms", "stroke_density", "tone", "intensity")


_add(
    "recipe_bundles",
    BEATS_CHUNKS + """ select track_id, track_id % 4 = 0 and n <> 1 as mismatched, chunk_idx as chapter_idx, at_ms, end_ms, case when has then case when chunk_idx % 2 = 0 then 'half' else '4' end end as stroke_density, case when has then 'rise' end as tone, case when has then chunk_idx / 8 end as intensity
    from (select *, count(*) over (partition by track_id) as n, track_id % 4 <> 0 or chunk_idx = 0 as has from chunks)""",
    _bundles,
)


def _beat_maps(spark: SparkSession, d: str) -> DataFrame:
    """Beat maps written as documents and read again with their schema."""
    b = _beats(spark, d)
    tracks = b.groupBy(TRACK).agg(F.lit(120.0).alias("bpm"), F.max("at_ms").alias("duration_ms"), F.max(F.when(F.col(TRACK) % 2 == 0, F.col("at_ms"))).alias("damaged_after_ms"))
    back = sinks.beat_maps(b, tracks).select(TRACK, F.from_json("doc", sources.BEAT_MAP).alias("m"))
    return back.select(TRACK, "m.bpm", "m.duration_ms", "m.damaged_after_ms", F.size("m.beats").alias("n"), F.size("m.downbeats").alias("n_downbeats"), F.array_max("m.beats").alias("last"), F.aggregate("m.energy", F.lit(0.0), lambda a, x: a + x).alias("energy"))


_add("beat_maps", f"with {CTE['beats']} select track_id, 120e0 as bpm, max(at_ms) as duration_ms, case when track_id % 2 = 0 then max(at_ms) end as damaged_after_ms, cast(count(*) as int) as n, cast((count(*) + 3) // 4 as int) as n_downbeats, max(at_ms) as last, list_reduce(list_prepend(0e0, list(round(energy, 6) order by seq)), lambda a, x: a + x) as energy from beats group by track_id", _beat_maps)
_add("load_paths", f"select media_id, case when media_id % 5 = 0 then 'as is' when hit then 'cached' else 'extract' end as how, case when media_id % 5 = 0 then '/sound/' || media_id || '.FLAC' else slot end as load_path, case when media_id % 5 <> 0 then damaged_after_ms end as damaged_after_ms from ({catalog.ORACLE_SQL['cache_lookup']})", lambda spark, d: shell.load_paths(_files(spark, d).withColumn("path", F.when(F.col("media_id") % 5 == 0, F.concat(F.lit("/sound/"), F.col("media_id").cast("string"), F.lit(".FLAC"))).otherwise(F.col("path"))), _cache_lookup(spark, d)))
_add(
    "stale_files",
    "select count(*) as n, cast(coalesce(sum(o_custkey), 0) as bigint) as bytes from orders where epoch_us(o_orderdate) / 1e6 < 820454400 - 3600",
    lambda spark, d: shell.stale(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("timestamp").alias("modificationTime"), F.col("o_custkey").alias("length")), 820_454_400),
)


def _decodes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as decoding runs: how far they came, what is salvaged, what their logs and probes say."""
    x = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2_000_000).cast("long").alias("us"), (F.col("l_suppkey") % 3).alias("rc"), (F.col("l_partkey") % 100 * 1000).alias("source_ms"))
    line = F.when(F.col("l_linenumber") % 3 == 0, F.lit("out_time_us=N/A")).otherwise(F.concat(F.lit("out_time_us="), F.col("us").cast("string")))
    probe = F.when(F.col("l_linenumber") == 1, "Stream #0:0: Audio: aac").otherwise(F.concat(F.lit("Stream #0:1: Video: h264, yuv420p, "), (F.col("us") / 50_000).cast("int").cast("string"), F.lit("x720 [SAR 1:1 DAR 16:9]")))
    x = x.withColumns({"line": line, "probe": probe})
    x = sources.probe_dimensions(x.withColumnRenamed("line", "log").withColumnRenamed("probe", "line"))
    return x.select("l_orderkey", "l_linenumber", shell.progress_us(F.col("log")).alias("out_us"), shell.salvage_to(F.col("rc"), F.col("us")).alias("salvage_to"), shell.coverage_shortfall(F.col("us") / 1000, F.col("source_ms")).alias("warning"), "width", "height")


_add(
    "decode_reports",
    """select l_orderkey, l_linenumber, case when l_linenumber % 3 <> 0 then us end as out_us, case when rc <> 0 and us >= 30000000 and us / 1e6 - 8 > 1 then us / 1e6 - 8 end as salvage_to,
        case when source_ms > 0 and us / 1000 < source_ms * 0.98e0 and source_ms - us / 1000 >= 5000 then 'decoded ' || us // 1000 || ' of ' || source_ms || ' ms' end as warning, case when l_linenumber <> 1 and us // 50000 >= 100 then cast(us // 50000 as int) end as width, case when l_linenumber <> 1 and us // 50000 >= 100 then 720 end as height
    from (select l_orderkey, l_linenumber, cast(l_quantity * 2000000 as bigint) as us, l_suppkey % 3 as rc, l_partkey % 100 * 1000 as source_ms from lineitem)""",
    _decodes,
)


def _probe_texts(spark: SparkSession, d: str) -> DataFrame:
    """Probes of parts: sound, a video stream, a cover picture; some have sound only, some are cut off."""
    stream = lambda kind, *own: F.to_json(F.struct(F.lit(kind).alias("codec_type"), *own))
    codec = F.when(F.col("p_size") % 4 == 0, "hevc").otherwise("H264").alias("codec_name")
    video = stream("video", codec, (F.col("p_size") * 64).alias("width"), F.lit("30/1").alias("r_frame_rate"), F.when(F.col("p_size") % 5 == 0, "2080658801/99461181").otherwise("30000/1001").alias("avg_frame_rate"))
    parts = [F.lit('{"streams":['), stream("audio", F.lit("aac").alias("codec_name"))]
    doc = F.when(F.col("p_size") % 7 == 0, F.concat(*parts, F.lit("]}"))).otherwise(F.concat(*parts, F.lit(","), video, F.lit(","), stream("video", F.lit("mjpeg").alias("codec_name")), F.lit("]}")))
    doc = F.when(F.col("p_size") % 11 == 0, F.left(doc, F.lit(25))).otherwise(doc)
    media = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("media_id"), doc.alias("probe"))
    return shell.direct_play(media.select("media_id", shell.first_video(F.col("probe")).alias("video")))


_add(
    "direct_play_probes",
    "select p_partkey as media_id, there and p_size % 5 <> 0 as cfr, there and p_size % 5 <> 0 and p_size % 4 <> 0 and p_size * 64 <= 2560 as direct from (select *, p_size % 7 <> 0 and p_size % 11 <> 0 as there from part)",
    _probe_texts,
)
