"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dac, decontaminate, editcounts, licenses, lines, media, packing, quality, simhash, urls
from .base import materialize, table
from .tokens import vocabulary_path


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dac.read_ids(dac.write_ids(table(spark, sf_dir, "documents"), vocabulary_path()))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path())


def made_edits() -> Column:
    """Four edits for a row of documents, at places that its id and length give."""
    n = F.coalesce(F.length("text"), F.lit(0))
    place = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1)
    words = F.array(*map(F.lit, ("new", " word", "'s", " two words ", "\n", "ing,")))
    made = [(place(1), F.lit(0), F.get(words, F.pmod("doc_id", F.lit(6)).cast("int"))), (place(2), F.pmod(F.xxhash64("doc_id"), F.lit(40)), F.lit("")), (place(3), F.lit(3), F.lit("changed")), (n, F.lit(0), F.lit(" the end"))]
    return F.array(*[F.struct(a.cast("long").alias("at"), d.cast("long").alias("delete"), i.alias("insert")) for a, d, i in made])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after four edits each; the edits start from a stored table of all trees."""
    stored = materialize(editcounts.trees(table(spark, sf_dir, "documents"), vocabulary_path()), "trees")
    after = editcounts.edit(stored.withColumn("edits", made_edits()), vocabulary_path(), digest=True)
    return after.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_after"), "n_leaves", "leaves_encoded", F.col("n_chars").alias("n_chars_after"), F.col("text_crc32").alias("text_after_crc32"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(media.store_texts(table(spark, sf_dir, "documents")), "media")
    found = media.inspect(stored)
    feature = F.format_string("%s corrected=%s samples=%d blocks=%d mean=%.6f embedded=%s", "detected", "corrected", "body_bytes", (F.col("body_bytes") / media.BLOCK).cast("long"), "sample_mean", F.array_join(F.transform("embedded", lambda e: F.concat_ws(":", e.kind, e.offset, e.length)), "|"))
    return found.select("doc_id", "n_bytes", F.col("body_bytes").alias("payload_bytes"), F.col("body_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup(table(spark, sf_dir, "documents"), exact_chars=1)
    return cut.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__kept").alias("n_kept"), F.md5("text").alias("kept_md5"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_licenses, op2_token_files, op3_url_filter, op4_quality, op5_packing, op6_token_counts, op7_media, op8_decontamination, op9_line_dedup, op10_simhash)}
ORACLE_SQL: dict[str, str] = {
    # every shingle of every document against every item's
    "op8_decontamination": r"""
        with words as (select *, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') as w
            from (select 'item' as kind, item_id as id, text from benchmark union all select 'doc', doc_id, text from documents)),
        items as (select id, least(5, len(w)) as n, w from words where kind = 'item' and len(w) > 0),
        own as (select distinct id as item_id, n, array_to_string(w[i:i + n - 1], ' ') as s from (select *, unnest(range(1, len(w) - n + 2)) as i from items)),
        counted as (select *, count(*) over (partition by item_id) as k from own),
        docs as (select id as doc_id, n, array_to_string(w[i:i + n - 1], ' ') as s from (
            select d.id, z.n, d.w, unnest(range(1, len(d.w) - z.n + 2)) as i from words d, (select distinct n from items) z where d.kind = 'doc')),
        met as (select c.item_id, d.doc_id, c.k, count(distinct d.s) as m from docs d join counted c on c.n = d.n and c.s = d.s group by all)
        select item_id, doc_id, m / k as containment from met where m / k >= 0.8 - 1e-12""",
    # every line that isn't blank goes by equality, those of 20 characters and more also within one edit: such pairs
    # share a first or last half, and Levenshtein distance decides
    "op9_line_dedup": """
        with split as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
        norm as (select doc_id, pos, line, lower(trim(line, ' ' || chr(9) || chr(13))) as n from split),
        firsts as (select n, length(n) as len, min((doc_id, pos)) as place from norm where n <> '' group by n),
        long as (select * from firsts where len >= 20),
        halves as (
            select *, len as of_len, 1 as side, left(n, len // 2) as half from long
            union all select *, len, 2, right(n, len - len // 2) from long
            union all select *, len - 1, 1, left(n, (len - 1) // 2) from long
            union all select *, len - 1, 2, right(n, len - 1 - (len - 1) // 2) from long),
        near as (select distinct b.n from halves a join halves b using (of_len, side, half) where a.place < b.place and abs(a.len - b.len) <= 1 and levenshtein(a.n, b.n) <= 1),
        judged as (
            select doc_id, pos, line, norm.n = '' or (near.n is null and (doc_id, pos) = firsts.place) as keep
            from norm left join firsts on norm.n = firsts.n left join near on norm.n = near.n)
        select d.doc_id, cast(coalesce(j.n_lines, 0) as bigint) as n_lines, cast(coalesce(j.n_kept, 0) as bigint) as n_kept,
            case when d.text is null then null when j.n_lines = j.n_kept then md5(d.text) else md5(coalesce(j.kept, '')) end as kept_md5
        from documents d left join (
            select doc_id, count(*) as n_lines, count(*) filter (keep) as n_kept, string_agg(line, chr(10) order by pos) filter (keep) as kept
            from judged group by doc_id) j using (doc_id)""",
}
