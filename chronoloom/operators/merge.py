"""Field-level merge of authored and analysed records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.exprs import TRACK


@dataclass(frozen=True)
class Fields:
    """Which fields a record has, by who may write them; fields beyond these are carried along."""

    key: tuple[str, ...]
    analytical: tuple[str, ...]
    authored: tuple[str, ...]
    mixed: tuple[str, ...]
    structural: tuple[str, ...]

    @property
    def known(self) -> tuple[str, ...]:
        return (*self.analytical, *self.authored, *self.mixed, *self.structural, "auto_generated")


CHAPTER = Fields(("at_ms",), ("content_type", "voice_label", "confidence", "evidence"), ("name", "intent", "include"), ("tone", "shape"), ("at_ms", "end_ms"))
STANZA = Fields(("chapter_idx", "at_ms"), ("mode", "confidence", "evidence"), ("intent",), ("tone",), ("chapter_idx", "at_ms", "end_ms"))
MODES = frozenset({"break", "tease", "slow", "steady", "fast", "edging"})
CONTENT = frozenset({"", "driving", "calm", "varied", "music", "ambient", "mixed"})


def merge_records(existing: DataFrame, incoming: DataFrame, fields: Fields, mode: str) -> DataFrame:
    """Merge ``(track_id, ord, fields map<string,string>)`` rows by key; a map without a field is a record without it.

    Existing records keep their order (of equal keys the first stays), unmatched incoming ones follow, duplicates
    among them too; nothing is deleted. A record whose auto_generated is "false" is latched: it stays as it is.
    analyze writes analytical and mixed fields that are present; edit also authored ones, and latches the record
    unless told otherwise. Structural fields are never rewritten; unknown ones only where they were absent.
    """
    if mode not in ("analyze", "edit"):
        raise ValueError(f"unknown mode {mode!r}")
    keys = [f"k_{k}" for k in fields.key]
    keyed = lambda df: df.select(TRACK, "ord", "fields", *[F.col("fields")[k].alias(f"k_{k}") for k in fields.key])
    first = lambda df: df.withColumn("r", F.row_number().over(Window.partitionBy(TRACK, *keys).orderBy("ord"))).where("r = 1").drop("r")
    old, new = first(keyed(existing)), keyed(incoming)
    match = first(new).select(TRACK, *keys, F.col("fields").alias("new"))
    on = [F.col(f"o.{TRACK}") == F.col(f"n.{TRACK}"), *[F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]]
    both = old.alias("o").join(match.alias("n"), on, "left").select(f"o.{TRACK}", "o.ord", F.col("o.fields").alias("old"), "n.new")

    writable = [*fields.analytical, *fields.mixed, *(fields.authored if mode == "edit" else ())]
    has = lambda m, k: F.map_contains_key(m, k)
    given, old_, new_ = F.array(*map(F.lit, writable)), F.col("old"), F.col("new")
    taken = F.map_filter(new_, lambda k, _: F.array_contains(given, k))
    unknown = F.map_filter(new_, lambda k, _: ~k.isin(*fields.known) & ~has(old_, k))
    if mode == "edit":
        flag = F.create_map(F.lit("auto_generated"), F.coalesce(new_["auto_generated"], F.lit("false")))
    else:
        flag = F.map_filter(new_, lambda k, _: k == "auto_generated")
    kept = F.map_filter(old_, lambda k, _: ~has(taken, k) & ~has(flag, k))
    latched = F.coalesce(old_["auto_generated"] == "false", F.lit(False))
    merged = both.select(TRACK, F.lit(0).alias("part"), "ord", F.when(new_.isNull() | latched, old_).otherwise(F.map_concat(kept, taken, flag, unknown)).alias("fields"))
    gone = [F.col(f"i.{TRACK}") == F.col(f"e.{TRACK}"), *[F.col(f"i.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]]
    appended = new.alias("i").join(keyed(existing).select(TRACK, *keys).distinct().alias("e"), gone, "left_anti").select(F.col(f"i.{TRACK}").alias(TRACK), F.lit(1).alias("part"), F.col("i.ord").alias("ord"), F.col("i.fields").alias("fields"))
    out = merged.unionByName(appended)
    return out.select(TRACK, (F.row_number().over(Window.partitionBy(TRACK).orderBy("part", "ord")) - 1).cast("int").alias("ord"), "fields")


def invalid_records(records: DataFrame) -> DataFrame:
    """Records whose mode or content_type is outside its closed list."""
    bad = lambda f, values: F.coalesce(~F.col("fields")[f].isin(*values), F.lit(False))
    return records.where(bad("mode", MODES) | bad("content_type", CONTENT))


def provenance(existing: DataFrame, writer: str, mode: str, touched: Column, written_at: Column, version: str) -> DataFrame:
    """The provenance table and one entry per track more; the analyzer's version is stamped only when it analyses."""
    entry = existing.groupBy(TRACK).agg(F.max("n").alias("n")).select(TRACK, (F.col("n") + 1).alias("n"), F.lit(writer).alias("writer"), written_at.alias("written_at"), F.when(F.lit(mode == "analyze"), F.lit(version)).alias("version"), touched.alias("fields"))
    return existing.unionByName(entry)


SCHEMA, VERSION = "timeline", "3.0"
DOCUMENT = "track_id long, schema string, version string, analyzer_version string, auto_generated boolean, generated_by string, energy string, extras map<string,string>"


def fields_touched() -> Column:
    """Which blocks a payload row (n_chapters, n_stanzas, energy) fills."""
    flags = F.array(*[F.when(c, F.lit(n)) for n, c in (("chapters", F.col("n_chapters") > 0), ("stanzas", F.col("n_stanzas") > 0), ("energy", F.coalesce(F.col("energy") != "{}", F.lit(False))))])
    return F.filter(flags, lambda x: x.isNotNull())


def normalise_documents(docs: DataFrame) -> DataFrame:
    """Defaults of older documents: a schema name, version 1.0."""
    return docs.withColumns({"schema": F.coalesce("schema", F.lit(SCHEMA)), "version": F.coalesce("version", F.lit("1.0"))})


_KNOWN = ("schema", "version", "analyzer_version", "auto_generated", "generated_by", "energy", "chapters", "stanzas", "provenance")


def read_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs(track_id, doc)``, JSON of any version, as (documents, records, rejects).

    documents: DOCUMENT rows with defaults filled in, unknown fields as JSON in extras. records: (track_id, kind, ord,
    fields) of chapters and stanzas, in ``normalise_records``' form; fields are text, nested ones JSON. A bare list is the
    oldest form, a document of chapters alone. rejects: (track_id, error) for text that is no JSON object or list, and
    for blocks of the wrong kind; they give no other rows.
    """
    text = F.btrim("doc", F.lit(" \t\r\n"))
    whole = F.when(text.startswith("["), F.concat(F.lit('{"chapters":'), text, F.lit("}"))).otherwise(text)
    top = docs.select(TRACK, F.when(text.startswith("[") | text.startswith("{"), F.from_json(whole, "map<string,string>", {"mode": "PERMISSIVE"})).alias("m"))
    lists = [F.col("m")[k] for k in ("chapters", "stanzas", "provenance")]
    not_list = lambda x: F.coalesce(~F.ltrim(x).startswith("["), F.lit(False))
    error = F.when(F.col("m").isNull(), "not a JSON object or list")
    for name, x in zip(("chapters", "stanzas", "provenance"), lists):
        error = error.when(not_list(x), f"'{name}' must be a list")
    error = error.when(F.coalesce(~F.ltrim(F.col("m")["energy"]).startswith("{"), F.lit(False)), "'energy' must be an object")
    top = top.withColumn("error", error)
    good = top.where("error is null")
    documents = good.select(
        TRACK, F.coalesce(F.col("m")["schema"], F.lit(SCHEMA)).alias("schema"), F.coalesce(F.col("m")["version"], F.lit("1.0")).alias("version"), F.col("m")["analyzer_version"].alias("analyzer_version"),
        F.col("m")["auto_generated"].try_cast("boolean").alias("auto_generated"), F.col("m")["generated_by"].alias("generated_by"), F.col("m")["energy"].alias("energy"), F.map_filter("m", lambda k, _: ~k.isin(*_KNOWN)).alias("extras"),
    )
    kinds = F.explode(F.array(*[F.struct(F.lit(k[:-1]).alias("kind"), F.from_json(F.col("m")[k], "array<map<string,string>>").alias("list")) for k in ("chapters", "stanzas")]))
    each = good.select(TRACK, kinds.alias("k")).select(TRACK, "k.kind", F.posexplode("k.list").alias("ord", "fields")).where("fields is not null")
    return documents, normalise_records(each, documents), top.where("error is not null").select(TRACK, "error")


def normalise_records(records: DataFrame, docs: DataFrame) -> DataFrame:
    """Old user-edited documents (auto_generated false at the top) latch each record that says nothing itself; tone "none" is none."""
    latched = docs.where(~F.col("auto_generated")).select(TRACK, F.lit(True).alias("__edited")).distinct()
    r = records.join(latched, TRACK, "left")
    blank = F.transform_values("fields", lambda k, v: F.when((k == "tone") & (v == "none"), F.lit("")).otherwise(v))
    add = F.col("__edited") & ~F.map_contains_key("fields", F.lit("auto_generated"))
    return r.select(*[F.when(add, F.map_concat(blank, F.create_map(F.lit("auto_generated"), F.lit("false")))).otherwise(blank).alias("fields") if c == "fields" else F.col(c) for c in records.columns])


def merge_documents(existing: DataFrame, incoming: DataFrame, mode: str, analyzer_version: str = "1") -> DataFrame:
    """Top-level merge of one row per track (DOCUMENT): fresh where there was none, else field by field.

    The schema's version is set; edit clears auto_generated; the first generated_by stays; energy is replaced as a
    whole if given; unknown fields of the incoming row overwrite; only analyze stamps the analyzer's version.
    Documents that the incoming rows don't name stay as they are.
    """
    if mode not in ("analyze", "edit"):
        raise ValueError(f"unknown mode {mode!r}")
    o, n = normalise_documents(existing).alias("o"), incoming.alias("n")
    both = o.join(n, F.col(f"o.{TRACK}") == F.col(f"n.{TRACK}"), "full_outer")
    old, new = F.col(f"o.{TRACK}").isNotNull(), F.col(f"n.{TRACK}").isNotNull()
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce("o.extras", empty), F.coalesce("n.extras", empty)
    extras = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    auto = F.when(~old, F.coalesce("n.auto_generated", F.lit(True))).when(new & F.lit(mode == "edit"), F.lit(False)).otherwise(F.col("o.auto_generated"))
    return both.select(
        F.coalesce(f"o.{TRACK}", f"n.{TRACK}").alias(TRACK), F.when(new, F.lit(SCHEMA)).otherwise(F.col("o.schema")).alias("schema"), F.when(new, F.lit(VERSION)).otherwise(F.col("o.version")).alias("version"),
        F.when(new & F.lit(mode == "analyze"), F.lit(analyzer_version)).otherwise(F.col("o.analyzer_version")).alias("analyzer_version"), auto.alias("auto_generated"), F.coalesce("o.generated_by", "n.generated_by").alias("generated_by"),
        F.coalesce("n.energy", "o.energy").alias("energy"), extras.alias("extras"),
    )
