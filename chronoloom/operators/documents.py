"""Chapter, event and curve documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK


def timestamp_text(ms: Column, force_hours: Column | None = None) -> Column:
    """m:ss, or h:mm:ss from an hour on (or if forced); negative times are 0."""
    s = F.floor(F.greatest(F.lit(0), ms) / 1000)
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    hours = (h > 0) if force_hours is None else (h > 0) | force_hours
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(hours, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(sec))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(sec)))


def _joined(order: Column, text: Column, between: str) -> Column:
    """Aggregate: texts in order, joined; a track's chapters are few."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), between)


def youtube_block(chapters: DataFrame) -> DataFrame:
    """A description's chapter lines per track, or why there are none: fewer than 3, first not at 0, a gap under 10 s.

    ``chapters(track_id, seq, at_ms, name, intent)``.
    """
    track = Window.partitionBy(TRACK)
    order = track.orderBy("at_ms", "seq")
    c = chapters.select("*", F.row_number().over(order).alias("i"), (F.lead("at_ms").over(order) - F.col("at_ms")).alias("gap"), (F.max("at_ms").over(track) >= 3_600_000).alias("hours"))
    title = F.coalesce(F.nullif("name", F.lit("")), F.nullif("intent", F.lit("")), F.concat(F.lit("Chapter "), F.col("i").cast("string")))
    line = F.concat(timestamp_text(F.col("at_ms"), F.col("hours")), F.lit(" "), title)
    a = c.groupBy(TRACK).agg(F.count("*").alias("n"), F.min("at_ms").alias("first"), F.min("gap").alias("gap"), F.concat(_joined(F.col("i"), line, "\n"), F.lit("\n")).alias("text"))
    error = F.when(F.col("n") < 3, "fewer than 3 chapters").when(F.col("first") != 0, "first chapter not at 0").when(F.col("gap") < 10_000, "chapter under 10 s")
    return a.select(TRACK, error.alias("error"), F.when(error.isNull(), F.col("text")).alias("block"))


def ffmetadata(chapters: DataFrame) -> DataFrame:
    """An FFMETADATA1 text per track: ends filled from the next start, titles escaped."""
    order = Window.partitionBy(TRACK).orderBy("at_ms", "seq")
    end = F.coalesce(F.col("end_ms"), F.lead("at_ms").over(order), F.col("at_ms") + 1)
    title = F.coalesce(F.nullif("name", F.lit("")), F.nullif("intent", F.lit("")))
    for sign in ("\\", "=", ";", "#", "\n"):
        title = F.replace(title, F.lit(sign), F.lit("\\" + sign))
    c = chapters.select(TRACK, F.row_number().over(order).alias("i"), "at_ms", F.greatest(end, F.col("at_ms") + 1).alias("end"), title.alias("title"))
    text = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("at_ms").cast("string"), F.lit("\nEND="), F.col("end").cast("string"), F.lit("\n"), F.coalesce(F.concat(F.lit("title="), F.col("title"), F.lit("\n")), F.lit("")))
    return c.groupBy(TRACK).agg(F.concat(F.lit(";FFMETADATA1\n"), _joined(F.col("i"), text, "")).alias("text"))


def parse_events(rows: DataFrame) -> DataFrame:
    """Events of ``rows(track_id, seq, doc)`` JSON: type and at_ms required (else rejected), confidence 1 if absent."""
    schema = "type string, at_ms long, duration_ms long, confidence double, source array<string>"
    e = rows.select(TRACK, "seq", F.from_json("doc", schema).alias("e"), F.get_json_object("doc", "$.params").alias("params"))
    return e.select(TRACK, "seq", F.col("e.type").alias("type"), F.col("e.at_ms").alias("at_ms"), F.col("e.duration_ms").alias("duration_ms"), F.coalesce("e.confidence", F.lit(1.0)).alias("confidence"), F.coalesce("e.source", F.array().cast("array<string>")).alias("source"), "params", (F.col("e.type").isNull() | F.col("e.at_ms").isNull()).alias("rejected"))


def event_text(events: DataFrame) -> Column:
    """An event's JSON without fields that have their defaults."""
    return F.to_json(F.struct("type", "at_ms", "duration_ms", F.nullif("confidence", F.lit(1.0)).alias("confidence"), F.when(F.size("source") > 0, F.col("source")).alias("source"), F.from_json(F.nullif("params", F.lit("{}")), "map<string,int>").alias("params")))


def write_events(docs: DataFrame, events: DataFrame) -> DataFrame:
    """Replace each document's events, ordered by time (stable), and keep the rest: ``docs(track_id, doc variant-free JSON)``."""
    own = events.groupBy(TRACK).agg(F.transform(F.array_sort(F.collect_list(F.struct("at_ms", "seq", event_text(events).alias("j")))), lambda x: x["j"]).alias("events"))
    return docs.join(own, TRACK, "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))


def curve_documents(points: DataFrame, *, title: str = "", range_: int = 90) -> DataFrame:
    """One JSON document per track of exported points; tracks without points give none (an error where one is asked for)."""
    actions = F.array_sort(F.collect_list(F.struct(F.col("at_ms").alias("at"), "pos")))
    meta = F.struct(F.nullif(F.lit(title), F.lit("")).alias("title"))
    return points.groupBy(TRACK).agg(actions.alias("actions")).select(TRACK, F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(False).alias("inverted"), F.lit(range_).alias("range"), "actions", meta.alias("metadata"))).alias("doc"))


def beat_documents(beats: DataFrame, tempo: DataFrame) -> DataFrame:
    """A track's beats and downbeats as arrays, with tempo and duration (its last beat)."""
    at = F.transform(F.array_sort(F.collect_list(F.struct("seq", "at_ms"))), lambda x: x["at_ms"])
    down = F.transform(F.array_sort(F.collect_list(F.when(F.col("seq") % 4 == 0, F.struct("seq", "at_ms")))), lambda x: x["at_ms"])
    return beats.groupBy(TRACK).agg(F.max("at_ms").alias("duration_ms"), at.alias("beats_ms"), down.alias("downbeats_ms")).join(tempo, TRACK)
