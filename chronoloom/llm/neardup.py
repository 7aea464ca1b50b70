"""Near-duplicates at a similarity of word shingles: SimHash by multi-index hashing first, then what its radius can't see.

Texts at 0.8 differ in some ten of 64 bits, so a small Hamming ball finds the closest copies only, and a ball that covers
0.8 has no selective segments. What the fingerprints link (verified by the sets themselves) is one component from then on;
a set join with prefix filters, which lose nothing, finds every other pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .base import WordHashes, batch, discard, forgetting, join_hot, map_batches, materialize, shingle_hashes
from .simhash import _UPPER, components, name_members, one_of_each

SHINGLE = 5
#: Two texts are near-duplicates if 5 * |intersection| >= 4 * |union| (0.8); the filters below follow from these numbers.
PART, WHOLE = 4, 5
#: One text in SAMPLE is counted to find common shingles; they go last in the order, which affects time only.
SAMPLE, COMMON, MOST_COMMON = 64, 8, 100_000

_FP = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("prefix", pa.list_(pa.int64())), ("sim", pa.int64())])
_SET = pa.schema([("fp", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_TOKEN = pa.schema([("token", pa.int64())])


def shingle_set(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; words as in ``simhash.fingerprint``."""
    return np.unique(shingle_hashes(hashes.array((text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()), size)).view(np.int64)


def _set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def _fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes, as a signed long."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):  # blocks bound the unpacked bits of a very long text
        counts += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(own)).view(np.int64)[0])


def _common(docs: DataFrame, sample: int, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts have, by value, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            for t in b.column(0).to_pylist():
                yield batch(_TOKEN, {"token": shingle_set(t, hashes)})

    some = docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(sample)) == 0).select("text").distinct()
    counted = map_batches(some, forgetting(run), "token long").groupBy("token").count().where(F.col("count") >= common)
    rows = sorted((r[0], r[1]) for r in counted.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def _prefixes(docs: DataFrame, sample: int, common: int) -> DataFrame:
    """(doc_id, tie, fp, size, prefix, sim) of each row: fp names its set of shingles, prefix are the set's first in order."""
    values, counts = _common(docs, sample, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            fps, sizes, prefixes, sims = [], [], [], []
            for t in b.column(1).to_pylist():
                own = shingle_set(t, hashes)
                fps.append(_set_id(own))
                sizes.append(len(own))
                sims.append(_fingerprint(own))
                if len(values):
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    own = own[np.argsort(np.where(values[at] == own, counts[at], 0), kind="stable")]
                prefixes.append(own[: len(own) * (WHOLE - PART) // WHOLE + 1])
            yield batch(_FP, {"doc_id": b.column(0), "tie": b.column(2), "fp": fps, "size": sizes, "prefix": prefixes, "sim": sims})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")), forgetting(run), "doc_id long, tie long, fp long, size long, prefix array<long>, sim long")


def _possible(pairs: DataFrame) -> DataFrame:
    """``pairs(a, b, na, nb)``, one row per shared prefix shingle, to the (a, b) that can reach 0.8.

    Up to where the earlier of the two prefixes ends, all shared shingles are counted; behind it, at most the rest of
    that set can be shared.
    """
    rest = lambda n: F.col(n) - F.floor(F.col(n) * (WHOLE - PART) / WHOLE) - 1
    met = pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return met.where((PART + WHOLE) * (F.col("c") + F.greatest(rest("na"), rest("nb"))) >= PART * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, total: int) -> DataFrame:
    """Those ``pairs(a, b)`` whose sets reach 0.8; sets are made again from the texts of these pairs alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            sets = [shingle_set(t, hashes) for t in b.column(0).to_pylist()]
            yield batch(_SET, {"fp": [_set_id(s) for s in sets], "shingles": sets})

    pairs = materialize(pairs, "possible-pairs")
    if pairs.isEmpty():
        return pairs
    ties = distinct.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi").groupBy("own.tie").agg(F.sum("n").alias("n"))
    texts = join_hot(docs.select("text", F.xxhash64("text").alias("tie")), materialize(ties, "possible-texts"), "tie", "n", total).select("text")
    sets = materialize(map_batches(texts, forgetting(run), "fp long, shingles array<long>").dropDuplicates(["fp"]), "possible-sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return materialize(both.where((PART + WHOLE) * shared >= PART * (F.size("sa") + F.size("sb"))).select("a", "b"), "near-pairs")


def _alike(n: Column, m: Column) -> Column:
    return WHOLE * F.least(n, m) >= PART * F.greatest(n, m)


def _by_fingerprint(distinct: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose SimHash fingerprints are equal or within two bits: each through its fingerprint's first."""
    sims = distinct.select("fp", F.col("own.size").alias("size"), F.col("own.sim").alias("sim"))
    first = materialize(sims.groupBy("sim").agg(F.min(F.struct("fp", "size")).alias("one"), F.count("*").alias("n")), "fingerprints")
    same = sims.join(first.where("n > 1"), "sim").where("fp <> one.fp").select(F.col("one.fp").alias("a"), F.col("fp").alias("b"), F.col("one.size").alias("na"), F.col("size").alias("nb"))
    met = simhash.links(first.select(F.col("sim").alias("fp")))
    a, b = first.select(F.col("sim").alias("a"), F.col("one").alias("x")), first.select(F.col("sim").alias("b"), F.col("one").alias("y"))
    near = met.join(a, "a").join(b, "b").select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), F.col("x.size").alias("na"), F.col("y.size").alias("nb"))
    return same.unionByName(near).where(_alike(F.col("na"), F.col("nb"))).select("a", "b")


def links(docs: DataFrame, distinct: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) of ``distinct(fp, own, n)`` with a similarity of 0.8 or more, enough of them to connect all that such pairs connect.

    First what the fingerprints link. Then: two such sets share one of their first |set| / 5 + 1 shingles in any common
    order, so each set meets the least of each of its prefix's shingles (stars); then all pairs that share one, but for
    those already connected: a large cluster of near copies doesn't make all its pairs.
    """
    near = _verified(_by_fingerprint(distinct), docs, distinct, total)
    rooted = lambda df, edges: df.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = materialize(rooted(distinct.select("fp", "own.size", "own.prefix"), near).select("fp", "size", "root", F.explode("prefix").alias("token")), "prefixes")
    # which tokens join several components is learnt first, on two longs a row; few rows are left for the rest
    spread = rows.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    some = materialize(rows.join(materialize(spread, "spread-tokens"), "token", "left_semi"), "spread-prefixes")
    discard(rows)
    met = materialize(some.join(some.groupBy("token").agg(F.min(F.struct("fp", "size", "root")).alias("least")), "token"), "shared-prefixes")
    discard(some)
    stars = met.where("least.root <> root").select(F.col("least.fp").alias("a"), F.col("fp").alias("b"), F.col("least.size").alias("na"), F.col("size").alias("nb"))
    first = near.unionByName(_verified(_possible(stars.where(_alike(F.col("na"), F.col("nb")))), docs, distinct, total))
    left = rooted(met.select("token", "fp", "size"), first)
    several = left.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    left = materialize(left.join(several, "token", "left_semi"), "unconnected")
    discard(met)
    a, b = left.select("token", F.col("fp").alias("a"), F.col("size").alias("na"), F.col("root").alias("ra")), left.select("token", F.col("fp").alias("b"), F.col("size").alias("nb"), F.col("root").alias("rb"))
    rest = a.join(b, "token").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _alike(F.col("na"), F.col("nb")))
    return first.unionByName(_verified(_possible(rest), docs, distinct, total))


def keep_one(docs: DataFrame, *, sample: int = SAMPLE, common: int = COMMON) -> DataFrame:
    """One document of each component of near-duplicates, with all its columns; which one: as ``simhash.keep_one``.

    Linked: a Jaccard similarity of 0.8 or more of the sets of five-word shingles (by 64-bit hashes). A text of fewer
    words is one shingle; null and wordless texts are equal to each other. Very long texts are taken whole; other columns
    pass, whatever their names. Empty table: no rows.
    """
    fps = materialize(_prefixes(docs, sample, common), "shingle-prefixes")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(F.struct("tie", "size", "prefix", "sim")).alias("own")), "distinct-sets")
    members = materialize(fps.select("doc_id", "tie", "fp"), "set-members")
    discard(fps)
    return one_of_each(docs, name_members(members, distinct.select("fp", "first", "n"), links(docs, distinct, members.count())))
