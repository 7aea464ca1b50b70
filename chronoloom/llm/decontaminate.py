"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import WordHashes, batch, forgetting, map_batches, shingle_hashes, words_of

SHINGLE = 5
CONTAINMENT = 0.8
#: Benchmark words up to which the index (about 60 bytes a word) goes to every worker as a whole.
INDEX_WORDS = 2_000_000


def words(text: str | None) -> list[bytes]:
    """Words after lower-casing (all letters): runs of digits, letters a-z and non-ASCII characters."""
    return words_of((text or "").lower())


class Partition:
    """Items of alike numbers of distinct shingles: sketch hashes in order, whose they are, and the partition's own bounds.

    ``threshold``: the largest sketch hash. ``least``: the fewest distinct shingles that contain any of its items.
    """

    def __init__(self, length: int, sketches: list[tuple[np.ndarray, int, int]]) -> None:
        self.length, self.least = length, min(need for _, _, need in sketches)
        keys = np.concatenate([s for s, _, _ in sketches])
        owner = np.concatenate([np.full(len(s), i) for s, i, _ in sketches])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.threshold = keys[order], owner[order], keys.max()


class Index:
    """Benchmark items, partitioned by their number of distinct shingles (powers of two), each with a bottom-k sketch.

    An item of n shingles is contained if at least ceil(t n) of them are in the document, so at most
    m = n - ceil(t n) are missing: any m + 1 shingles, and so the m + 1 smallest hashes, include one that is there.
    That sketch makes the search lose nothing. A partition's threshold is its largest sketch hash: of a document's
    hashes only those up to it are looked up there, and a document with too few shingles for a partition's items skips
    it. Before that one bitmap over all sketches of a shingle length drops nearly all of the document's hashes.
    """

    def __init__(self, items: list[tuple[int, str | None]], size: int = SHINGLE, containment: float = CONTAINMENT) -> None:
        self.size, self.containment = size, containment
        hashes = WordHashes()
        self.items: list[tuple[int, frozenset[tuple[bytes, ...]]]] = []
        partitions: dict[int, list[tuple[np.ndarray, int, int]]] = defaultdict(list)
        for item, text in items:
            w = words(text)
            if not w:
                continue
            n = min(size, len(w))
            self.items.append((item, frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))))
            own = np.unique(shingle_hashes(hashes.array(w), size))
            if len(w) >= size:
                need = math.ceil(containment * len(own) - 1e-9)
                partitions[int(len(own)).bit_length()].append((own[: len(own) - need + 1], len(self.items) - 1, need))
            else:  # shorter than a shingle: looked for as a whole, by its own length
                partitions[-n].append((own, len(self.items) - 1, 1))
        self.partitions: dict[int, list[Partition]] = defaultdict(list)
        for kind, sketches in sorted(partitions.items()):
            length = -kind if kind < 0 else size
            self.partitions[length].append(Partition(length, sketches))
        self.tables = {}
        for length, parts in self.partitions.items():
            table = np.zeros(1 << 20, bool)
            for p in parts:
                table[(p.keys >> np.uint64(44)).astype(np.int64)] = True
            self.tables[length] = table

    def candidates(self, hashed: np.ndarray) -> set[int]:
        """Items a sketch hash of which is among the document's shingle hashes."""
        found: set[int] = set()
        for length, parts in self.partitions.items():
            if len(hashed) < length:
                continue
            own = shingle_hashes(hashed, length)
            possible = [p for p in parts if len(own) >= p.least]
            own = own[self.tables[length][(own >> np.uint64(44)).astype(np.int64)]]
            if not len(own):
                continue
            own = np.unique(own)
            for p in possible:
                some = own[: np.searchsorted(own, p.threshold, "right")]
                left, right = np.searchsorted(p.keys, some, "left"), np.searchsorted(p.keys, some, "right")
                for i, j in zip(left[right > left].tolist(), right[right > left].tolist()):
                    found.update(p.owner[i:j].tolist())
        return found

    def search(self, w: list[bytes], hashed: np.ndarray) -> list[tuple[int, float]]:
        """(item, containment) of the items that the document contains to the bound, by their shingles themselves."""
        candidates = self.candidates(hashed)
        if not candidates:
            return []
        out, shingles = [], {}
        for i in sorted(candidates):
            item, own = self.items[i]
            n = len(next(iter(own)))
            if n not in shingles:
                shingles[n] = set(zip(*(w[j : len(w) - n + 1 + j] for j in range(n))))
            share = len(own & shingles[n]) / len(own)
            if share >= self.containment - 1e-12:
                out.append((item, share))
        return out


OUT = "item_id long, doc_id long, containment double"
_OUT = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("containment", pa.float64())])


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark (the stated query set) in blocks of about so many words, one at a time; at least one, if empty."""
    block: list[tuple[int, str | None]] = []
    n = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        more = len(r.text or "") // 4 + 1
        if n + more > block_words and block:
            yield block
            block, n = [], 0
        block.append((r.item_id, r.text))
        n += more
    yield block


def find(docs: DataFrame, benchmark: DataFrame, *, size: int = SHINGLE, containment: float = CONTAINMENT, block_words: int = INDEX_WORDS) -> DataFrame:
    """Benchmark items contained in documents: one row per (item_id, doc_id), with the share of the item's distinct shingles.

    Documents are read as they lie, with no shuffle; whole texts count. A benchmark beyond ``block_words`` words is
    searched in blocks, one pass over the documents each, so what goes to the workers has a fixed bound. An item
    shorter than a shingle is one shingle, its whole word sequence. Null or wordless texts are in nothing and contain
    nothing. Null ids are kept, null; rows that share an id (also a null one) count as one: a pair of ids is given once,
    with its largest share. Empty tables: no rows. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for block in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, size, containment))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes, index = WordHashes(), shared.value
            for b in batches:
                found = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    w = words(text)
                    found += [(item, doc, share) for item, share in index.search(w, hashes.array(w))]
                if found:
                    yield batch(_OUT, dict(zip(_OUT.names, map(list, zip(*found)))))

        part = map_batches(rows, forgetting(run), OUT)
        out = part if out is None else out.unionByName(part)
    return out.groupBy("item_id", "doc_id").agg(F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, size: int = SHINGLE, containment: float = CONTAINMENT, block_words: int = INDEX_WORDS) -> DataFrame:
    """The documents that contain no benchmark item, with all their columns; no shuffle, one pass per block."""
    text = docs.columns.index("text")
    for block in _blocks(benchmark, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(Index(block, size, containment))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            hashes, index = WordHashes(), shared.value
            for b in batches:
                split = [words(t) for t in b.column(text).to_pylist()]
                yield b.filter(pa.array([not index.search(w, hashes.array(w)) for w in split], pa.bool_()))

        docs = map_batches(docs, forgetting(run), docs.schema)
    return docs
