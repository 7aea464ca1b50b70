"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import WordHashes, batch, forgetting, map_batches, materialize, remembered

BITS = 20
#: Labelled rows that a model is fitted on at most; which ones depends on their ids' hashes alone.
MOST_ROWS = 20_000
#: Characters of their texts at most, taken in the order of those hashes: bounds the one task that trains.
MOST_CHARS = 256_000_000
ACCEPT = 0.7
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")


def features(text: str | None) -> np.ndarray:
    """Places (with repeats) of the text's word 1- and 2-grams among 2**BITS; words and runs of signs, lower-cased."""
    words = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass").lower())
    h = remembered("quality", lambda: WordHashes(seed=7)).array(words)
    if not len(h):
        return np.zeros(0, np.int64)
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    return (np.concatenate([h, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def _sigmoid(z: np.ndarray | float):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """A feature's value is its count over the number of features, times SCALE."""

    weights: np.ndarray
    bias: float

    SCALE = 8.0

    def score(self, text: str | None) -> float:
        at = features(text)
        z = self.bias + (self.SCALE * float(self.weights[at].sum(dtype=np.float64)) / len(at) if len(at) else 0.0)
        return float(_sigmoid(z))


def train(rows: Iterable[tuple[str | None, int]], *, updates: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.0005, seed: int = 5) -> Model:
    """Per-coordinate FTRL-proximal over the rows, in a fixed shuffled order, in 1 to 20 passes that make ``updates`` updates.

    Texts are let go as they are read; places and values take 8 bytes a feature, in three arrays that go as a whole.
    """
    n = np.zeros(1 << BITS)
    z = np.zeros(1 << BITS)
    bias_n = bias_z = bias = 0.0
    places, values, ends, wanted = array("i"), array("f"), array("q", [0]), []
    for text, y in rows:
        at, counts = np.unique(features(text), return_counts=True)
        places.frombytes(at.astype(np.int32).tobytes())
        values.frombytes((Model.SCALE * counts / max(1, counts.sum())).astype(np.float32).tobytes())
        ends.append(len(places))
        wanted.append(y)
    places, values = np.frombuffer(places, np.int32), np.frombuffer(values, np.float32)
    order = np.random.default_rng(seed)
    for _ in range(max(1, min(20, round(updates / max(1, len(wanted)))))):
        for i in order.permutation(len(wanted)):
            own = slice(ends[i], ends[i + 1])
            at, x, y = places[own], values[own], wanted[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            g = float(_sigmoid(bias + float(w @ x))) - y
            gi = g * x
            sigma = (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / alpha
            z[at] += gi - sigma * w
            n[at] += gi * gi
            sigma = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z += g - sigma * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w.astype(np.float32), float(bias))


def sample(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS) -> DataFrame:
    """(rank, doc_id, text, quality): the labelled rows that a model is fitted on, one row per doc_id.

    Of rows with the same doc_id the one with the smallest text hash. At most about ``most_rows`` doc_ids, those with the
    smallest hashes, of these as many in that order as make ``most_chars`` characters (the first one in any case).
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    picked = own.where(rank < F.lit(int((1 << 40) * min(1.0, most_rows / max(1, own.count()))))).withColumn("rank", rank)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the picked ids are bounded by most_rows, so they may be broadcast, and one window may go over them
    tied = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "rank", "quality").agg(F.min(F.xxhash64("text")).alias("tie"), F.max(F.length("text")).alias("chars"))
    before = F.coalesce(F.sum("chars").over(Window.orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.coalesce("chars", F.lit(0))
    used = materialize(tied.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.coalesce("chars", F.lit(0)) <= most_chars)).drop("before", "chars"), "training-rows")
    found = rows.withColumn("tie", F.xxhash64("text")).join(F.broadcast(used), ["doc_id", "tie"])
    # copies of one row are let go before they meet
    return found.groupBy("rank", "doc_id", "quality").agg(F.first("text").alias("text")).select("rank", "doc_id", "text", "quality")


def fit(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, most_chars: int = MOST_CHARS, updates: int = 60_000) -> Model:
    """Fit on labelled documents outside the held-out quarter (crc32 of the doc_id's digits mod 4 is 2).

    On a bounded ``sample``: at most about ``most_rows`` doc_ids, one row each, and ``most_chars`` characters, since one
    task trains. As many passes as make ``updates`` updates, 1 to 20. Label rows with null doc_id or quality, or for a
    doc_id of no document, are ignored; several labels of a doc_id: the lowest counts. No usable row: scores 0.5.
    Empty and null texts train the bias; very long texts are used whole.
    """
    rows = sample(docs, labels, most_rows=most_rows, most_chars=most_chars)
    # one task trains, on a bounded sample; ordered, so that the model doesn't hang on how rows arrive
    ordered = rows.repartition(1).sortWithinPartitions("rank", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ((t, y) for b in batches for t, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()))
        if (first := next(own, None)) is not None:
            model = train(itertools.chain([first], own), updates=updates)
            at = np.flatnonzero(model.weights)
            yield pa.RecordBatch.from_arrays([pa.array([model.bias], pa.float64()), pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([model.weights[at].astype("<f4").tobytes()], pa.binary())], names=["bias", "at", "weights"])

    got = map_batches(ordered, forgetting(run), "bias double, at binary, weights binary").collect()
    weights = np.zeros(1 << BITS, np.float32)
    for r in got:
        weights[np.frombuffer(bytes(r["at"]), "<i4")] = np.frombuffer(bytes(r["weights"]), "<f4")
    return Model(weights, got[0]["bias"] if got else 0.0)


OUT = "doc_id long, held_out boolean, score double, predicted int"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, *, accept: float = ACCEPT) -> DataFrame:
    """Score each row of ``docs(doc_id, text)``; the model (4 MB at most) goes to every worker.

    Null or empty text: the model's bias alone. Null doc_id: kept, held_out false. Repeated rows: kept, equal
    scores. Empty table: no rows. Other columns are never inputs.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [shared.value.score(t) for t in b.column(1).to_pylist()]
            yield batch(_OUT, {"doc_id": b.column(0), "held_out": b.column(2), "score": scores, "predicted": [int(s >= accept) for s in scores]})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2, F.lit(False))
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", held.alias("held_out")), forgetting(run), OUT)


def keep_good(docs: DataFrame, model: Model, *, accept: float = ACCEPT) -> DataFrame:
    """The rows whose text scores ``accept`` or more, with all their columns; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t) >= accept for t in b.column(text).to_pylist()], pa.bool_()))

    return map_batches(docs, forgetting(run), docs.schema)
