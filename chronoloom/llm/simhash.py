"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batch, join_hot, map_batches, materialize

DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Distinct fingerprints in one value of a segment beyond which its table is looked up by whole fingerprints.
HOT = 64

_UPPER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 values (repeats count)."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not w:
        return 0
    n = min(size, len(w))
    shingles = map(b" ".join, zip(*(w[j : len(w) - n + 1 + j] for j in range(n))))
    counts, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(s, SEED) for s in shingles])
    for at in range(0, len(raw), 1 << 19):  # blocks bound the unpacked bits of a very long text
        part = np.frombuffer(raw[at : at + (1 << 19)], np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
        total += len(part)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


_FP = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, *, size: int = SHINGLE) -> DataFrame:
    """(doc_id, tie, fp) of each row; fp: the fingerprint's bits as a signed long; tie: a hash of the text, for equal doc_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield batch(_FP, {"doc_id": b.column(0), "tie": b.column(2), "fp": fps.view(np.int64)})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")), run, "doc_id long, tie long, fp long")


def _upper(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _lower(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _ball(radius: int, shift: int = 0, least: int = 0) -> Column:
    """Masks over one 32-bit segment of ``least`` to ``radius`` (at most 2) bits, as an array of longs."""
    masks = [0] if least == 0 else []
    if radius >= 1 >= least:
        masks += [1 << i for i in range(32)]
    if radius >= 2:
        masks += [1 << i | 1 << j for i in range(32) for j in range(i)]
    return F.array(*[F.lit((m << shift) - (1 << 64) if m << shift >= 1 << 63 else m << shift).cast("long") for m in masks])


def links(table: DataFrame, *, hot: int = HOT) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints ``table(fp)`` that differ in one or two bits; none is lost.

    Two segments of 32 bits. Of at most two differing bits either at most one lies in the upper segment (its ball of
    radius 1: 33 look-ups), or both do and the lower segments are equal (ball of radius 0: one look-up). Each look-up
    fetches the fingerprints of a segment value, and whole distances are verified. A segment value that more than
    ``hot`` fingerprints share is never fetched as a whole: probes of it enumerate the other segment's ball too and
    look up whole fingerprints, so no probe fetches more than ``hot`` rows and no group is paired with itself.
    """
    table = table.select("fp").distinct()
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))

    def hot_values(segment: Column) -> DataFrame:
        return table.groupBy(segment.alias("key")).count().where(F.col("count") > hot).select("key")

    hot_upper, hot_lower = materialize(hot_values(_upper(F.col("fp"))), "hot-upper"), materialize(hot_values(_lower(F.col("fp"))), "hot-lower")

    upper_probes = table.select(F.col("fp").alias("a"), F.explode(F.transform(_ball(1), lambda m: _upper(F.col("fp")).bitwiseXOR(m))).alias("key"))
    rows = table.select(F.col("fp").alias("b"), _upper(F.col("fp")).alias("key")).join(hot_upper, "key", "left_anti")
    first = upper_probes.join(rows, "key").where((F.col("a") < F.col("b")) & (near <= DISTANCE)).select("a", "b")

    lower = table.select(F.col("fp").alias("fp"), _lower(F.col("fp")).alias("key")).join(hot_lower, "key", "left_anti")
    second = lower.select("key", F.col("fp").alias("a")).join(lower.select("key", F.col("fp").alias("b")), "key").where((F.col("a") < F.col("b")) & (near == DISTANCE)).select("a", "b")

    # the upper segment's value is hot: at distance d there, the lower segment's ball of radius 2 - d completes the key
    own = table.select(F.col("fp").alias("a"), _upper(F.col("fp")).alias("key")).join(hot_upper, "key", "left_semi")
    at_0 = own.select("a", F.explode(F.transform(_ball(2, 0, 1), lambda m: F.col("a").bitwiseXOR(m))).alias("b"))
    side = upper_probes.where(F.col("key") != _upper(F.col("a"))).join(hot_upper, "key", "left_semi")
    at_1 = side.select("a", F.explode(F.transform(_ball(1), lambda m: F.shiftleft("key", 32).bitwiseOR(_lower(F.col("a"))).bitwiseXOR(m))).alias("b"))
    # the lower segment's value is hot: both bits lie in the upper segment
    both = table.select(F.col("fp").alias("a"), _lower(F.col("fp")).alias("key")).join(hot_lower, "key", "left_semi")
    at_2 = both.select("a", F.explode(F.transform(_ball(2, 32, 2), lambda m: F.col("a").bitwiseXOR(m))).alias("b"))
    third = at_0.unionByName(at_1).unionByName(at_2).where(F.col("a") < F.col("b")).join(table.select(F.col("fp").alias("b")), "b").where(near <= DISTANCE).select("a", "b")
    return first.unionByName(second).unionByName(third)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges(a, b)``: root is the smallest (signed) node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014); each step's edges are written to the shared
    folder, and the driver only reads a count and a checksum. A star's centre is found by a partial aggregate, so no
    neighbourhood is ever gathered in one place. Ends when a round changes nothing: every edge then leads to a root.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    rooted = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct())


def _members(docs: DataFrame, size: int, hot: int) -> DataFrame:
    fps = materialize(fingerprints(docs, size=size), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    return name_members(fps, distinct, links(distinct, hot=hot))


def name_members(fps: DataFrame, distinct: DataFrame, edges: DataFrame, *, rows_of_hot: int = 100_000) -> DataFrame:
    """``fps(doc_id, tie, fp)`` with root and component_id, of ``distinct(fp, first, n)`` and its ``edges(a, b)``.

    Fingerprints that very many rows share (empty texts, one text copied everywhere) are looked up by a broadcast of
    bounded size, so no task gets all of their rows.
    """
    member = components(edges)
    rooted = distinct.join(member.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # only fingerprints that have links need their roots' names; others keep their own first document
    linked = member.select(F.col("node").alias("fp"), "root").join(named, "root").select("fp", "root", "component_id")
    by_fp = distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "first").alias("component_id"), "n")
    return join_hot(fps, materialize(by_fp, "named-fingerprints"), "fp", "n", fps.count(), rows_of_hot)


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of ``docs(doc_id, text)``.

    component_id: the smallest doc_id reachable over links of at most two differing bits, itself included. Null or
    wordless texts have fingerprint zero and link like others. Null doc_id: kept; it links, but names no component
    unless all of its component's are null (then null). Repeated rows are kept. Empty table: no rows. Other columns
    are ignored. Very long texts are taken whole. Copies share a row of the table of distinct fingerprints, so their number makes no pairs.
    """
    return _members(docs, size, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, size: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """One document of each component, with all its columns: the one whose doc_id names it.

    If several rows of a component bear that doc_id, the one with the smallest text hash stays, and one row of equal
    texts. Rows with null doc_id go, unless their whole component has none.
    """
    return one_of_each(docs, _members(docs, size, hot))


def one_of_each(docs: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name the components of ``members``.

    A row's own columns travel in one, so that none of their names can meet the join's.
    """
    named = members.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    keep = materialize(named.groupBy("root").agg(F.min("doc_id").alias("keep"), F.min("tie").alias("tie"), F.count("*").alias("n")).drop("root"), "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("own"))
    out = own.join(keep, F.col("doc").eqNullSafe(F.col("keep")) & (F.col("own") == F.col("tie")), "left_semi")
    if not keep.where("n > 1").isEmpty():
        out = out.dropDuplicates(["doc", "own"])
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns])
