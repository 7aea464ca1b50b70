"""Timelines read from event tables and JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoloom.functions.exprs import nearest_millis

#: One minute of the event table is one millisecond of a track.
COMPRESSION_MS = 60_000

BEAT_MAP = T.StructType([
    T.StructField("bpm", T.DoubleType()), T.StructField("duration_ms", T.LongType()), T.StructField("beats", T.ArrayType(T.LongType())),
    T.StructField("downbeats", T.ArrayType(T.LongType())), T.StructField("stanzas", T.ArrayType(T.StructType([T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType())]))),
    T.StructField("energy", T.ArrayType(T.DoubleType())), T.StructField("damaged_after_ms", T.LongType()),
])


def canonical_beats(events: DataFrame, *, compression_ms: int = COMPRESSION_MS) -> DataFrame:
    """Each user's events as one track: seq, at_ms from its first event, energy in 1024ths of its loudest, pos 0 to 100."""
    raw = events.select(F.col("user_id").alias("track_id"), "event_id", nearest_millis(F.col("ts")).alias("ms"), "value", "event_type", "props")
    track = Window.partitionBy("track_id")
    ordered = raw.select("*", F.min("ms").over(track).alias("m0"), F.max("value").over(track).alias("mx"), (F.row_number().over(track.orderBy("ms", "event_id")) - 1).cast("int").alias("seq"))
    energy = F.when(F.col("mx") > 0, F.floor(F.col("value") / F.col("mx") * 1024) / F.lit(1024.0)).otherwise(0.0)
    pos = F.greatest(F.lit(0), F.least(F.lit(100), F.floor("value"))).cast("int")
    return ordered.select("track_id", "seq", F.floor((F.col("ms") - F.col("m0")) / compression_ms).cast("long").alias("at_ms"), energy.alias("energy"), pos.alias("pos"), "event_id", "event_type", "props")


def load_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_beats(spark.read.parquet(f"{sf_dir}/events.parquet")).select("track_id", "seq", "at_ms", "energy", "pos")


def read_beat_maps(spark: SparkSession, path: str) -> DataFrame:
    """Beat-map JSON documents, one row per beat; a document without beats or bpm is an error row (beats null)."""
    docs = spark.read.schema(BEAT_MAP).option("multiLine", True).json(path).withColumn("track", F.input_file_name())
    return docs.select("track", "bpm", "duration_ms", "damaged_after_ms", F.posexplode_outer(F.arrays_zip("beats", "energy")).alias("seq", "b")).select("track", "bpm", "duration_ms", "damaged_after_ms", "seq", F.col("b.beats").alias("at_ms"), F.col("b.energy").alias("energy"))


def normalise_actions(actions: DataFrame) -> DataFrame:
    """Clamp positions to 0..100; order stays (at_ms, seq), a stable sort by time."""
    return actions.withColumn("pos", F.greatest(F.lit(0), F.least(F.lit(100), F.col("pos"))).cast("int"))


def parse_chapters(rows: DataFrame) -> DataFrame:
    """Chapter records by their spellings: at_ms, else start_ms, else at; intent, else intent_proposal; rejects flagged."""
    at = F.coalesce("at_ms", "start_ms", "at").cast("long")
    return rows.select("track_id", at.alias("at_ms"), F.col("end_ms").cast("long").alias("end_ms"), F.coalesce(F.nullif("intent", F.lit("")), "intent_proposal", F.lit("")).alias("intent"), at.isNull().alias("rejected"))


def probe_chapters(docs: DataFrame) -> DataFrame:
    """Chapters of a media probe's JSON (column probe): seconds as text to milliseconds, halves to even; bad ones go."""
    schema = "chapters array<struct<start_time:string,end_time:string,tags:struct<title:string>>>"
    each = docs.select("track_id", F.posexplode(F.from_json("probe", schema)["chapters"]).alias("idx", "c"))
    ms = lambda c: F.rint(F.expr(f"try_cast({c} as double)") * 1000).cast("long")
    return each.select("track_id", "idx", ms("c.start_time").alias("at_ms"), ms("c.end_time").alias("end_ms"), F.coalesce("c.tags.title", F.lit("")).alias("name")).where("at_ms is not null")


def resolve_chapters(sources: DataFrame) -> DataFrame:
    """The first source (by priority) that has a list at all, even an empty one, gives a track's chapters."""
    return sources.where("chapters is not null").groupBy("track_id").agg(F.min_by("source", "priority").alias("source"), F.min_by("chapters", "priority").alias("chapters"))


CHAPTER = "struct<at_ms:bigint,start_ms:bigint,at:bigint,end_ms:bigint,name:string,intent:string,intent_proposal:string,content_type:string,tone:string,confidence:double,evidence:array<string>>"
#: Older names of textures.
LEGACY_TEXTURES = {"music": "driving", "ambient": "calm", "mixed": "varied"}


def _chapter_rows(chapters: DataFrame) -> DataFrame:
    """(track_id, chapters array) to one row per chapter that has a time, by its spellings."""
    c = chapters.select("track_id", F.posexplode("chapters").alias("idx", "c")).select("track_id", "idx", "c.*")
    at = F.coalesce("at_ms", "start_ms", "at")
    texture = F.col("content_type")
    for old, new in LEGACY_TEXTURES.items():
        texture = F.when(F.col("content_type") == old, F.lit(new)).otherwise(texture)
    blank = lambda c: F.coalesce(c, F.lit(""))
    return c.select("track_id", "idx", at.alias("at_ms"), "end_ms", blank("name").alias("name"), blank(F.coalesce(F.nullif("intent", F.lit("")), F.col("intent_proposal"))).alias("intent"), blank(texture).alias("content_type"), blank(F.nullif("tone", F.lit("none"))).alias("tone"), "confidence", F.coalesce("evidence", F.array().cast("array<string>")).alias("evidence")).where("at_ms is not null")


def document_chapters(docs: DataFrame) -> DataFrame:
    """Chapters of JSON documents (column doc): an object with a list, or the bare list. Unreadable text: none."""
    array = F.coalesce(F.from_json("doc", f"struct<chapters:array<{CHAPTER}>>")["chapters"], F.when(F.ltrim("doc").startswith("["), F.from_json("doc", f"array<{CHAPTER}>")))
    return _chapter_rows(docs.select("track_id", array.alias("chapters")))


def analysis_chapters(docs: DataFrame) -> DataFrame:
    """Chapters of analysis documents: confirmed ones, where there are any, else the proposals."""
    d = F.from_json("doc", f"struct<metadata:struct<chapters:array<{CHAPTER}>>,chapter_proposals:array<{CHAPTER}>>")
    confirmed = d["metadata"]["chapters"]
    return _chapter_rows(docs.select("track_id", F.when(F.size(confirmed) > 0, confirmed).otherwise(d["chapter_proposals"]).alias("chapters")))


def recipe_bundles(docs: DataFrame) -> DataFrame:
    """Bundles' chapters and recipes, paired by place; a bundle whose lists differ in length is flagged."""
    b = docs.select("track_id", F.from_json("doc", "struct<chapters:array<struct<at_ms:bigint,end_ms:bigint>>,recipes:array<struct<source:string,stroke_density:string,tone:string,emphasize_beats:boolean,intensity:double>>>").alias("b"))
    n = F.size("b.chapters")
    return b.select("track_id", (n != F.size("b.recipes")).alias("mismatched"), F.posexplode(F.arrays_zip("b.chapters", "b.recipes")).alias("chapter_idx", "x")).select("track_id", "mismatched", "chapter_idx", "x.chapters.*", "x.recipes.*")


def mono(samples: DataFrame, channels: int) -> DataFrame:
    """Chunks of interleaved samples (data array<float>) as means over their channels."""
    if channels == 1:
        return samples
    size = F.floor(F.size("data") / channels).cast("int")
    mean = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(F.slice("data", i * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels)
    return samples.withColumn("data", F.when(size > 0, mean).otherwise(F.array().cast("array<double>")))


def parse_stanzas(rows: DataFrame) -> DataFrame:
    """Stanza JSON (column doc): chapter_idx, at_ms, end_ms and mode are required, else the row is rejected."""
    s = F.from_json("doc", "chapter_idx int, at_ms bigint, end_ms bigint, mode string, confidence double, source string, intent string, tone string, evidence array<string>, auto_generated boolean")
    out = rows.select("track_id", s.alias("s")).select("track_id", "s.*")
    need = [F.col(c).isNull() for c in ("chapter_idx", "at_ms", "end_ms", "mode")]
    blank = {c: F.coalesce(c, F.lit("")) for c in ("source", "intent", "tone")}
    return out.withColumns({**blank, "auto_generated": F.coalesce("auto_generated", F.lit(True)), "rejected": need[0] | need[1] | need[2] | need[3]})


def load_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents of a known schema; a corrupt one counts as absent."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path).where("_corrupt is null").drop("_corrupt")


def probe_dimensions(lines: DataFrame) -> DataFrame:
    """Width and height from a probe's text (column line), null where it names none."""
    size = lambda i: F.regexp_extract("line", r"Video:[^\n]*?\b(\d{3,5})x(\d{3,5})\b", i).try_cast("int")
    return lines.select("*", size(1).alias("width"), size(2).alias("height"))
