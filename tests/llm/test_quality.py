import math
import random
import zlib
from collections import Counter

import numpy as np

from chronoloom.llm import quality
from chronoloom.llm.queries import op4_quality


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op4_quality(spark, sf).collect()}
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([p == q for p, q in held]) > 0.93
    good = [p for p, q in held if q == 1]
    assert np.mean(good) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality", "toxic")
    a, b = quality.fit(docs, labels, updates=2000), quality.fit(docs, flipped, updates=2000)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def test_model_does_not_hang_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    a, b = quality.fit(docs, labels, updates=1000), quality.fit(docs.repartition(7, "text"), labels.repartition(3), updates=1000)
    assert a.bias == b.bias and (a.weights == b.weights).all()


def plain_ftrl(rows, passes, alpha=0.3, beta=1.0, l1=0.002, l2=0.0005, seed=5):
    """FTRL-proximal feature by feature, in dictionaries."""
    z, n, bz, bn = {}, {}, 0.0, 0.0

    def weight(z, n, l1):
        return 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((beta + math.sqrt(n)) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            text, y = rows[i]
            at = Counter(quality.features(text).tolist())
            x = {k: float(np.float32(8.0 * c / max(1, sum(at.values())))) for k, c in at.items()}
            w = {k: weight(z.get(k, 0.0), n.get(k, 0.0), l1) for k in x}
            bias = weight(bz, bn, 0.0)
            g = 1 / (1 + math.exp(-(bias + sum(w[k] * v for k, v in x.items())))) - y
            for k, v in x.items():
                gk = g * v
                sigma = (math.sqrt(n.get(k, 0.0) + gk * gk) - math.sqrt(n.get(k, 0.0))) / alpha
                z[k] = z.get(k, 0.0) + gk - sigma * w[k]
                n[k] = n.get(k, 0.0) + gk * gk
            sigma = (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha
            bz, bn = bz + g - sigma * bias, bn + g * g
    return {k: weight(z[k], n[k], l1) for k in z}, bias


def test_training_against_plain_updates():
    rng = random.Random(2)
    rows = [(" ".join(rng.choices(["good", "bad", "a", "b", "c!", "D"], k=rng.randrange(0, 9))), rng.randrange(2)) for _ in range(30)] + [(None, 1)]
    model = quality.train(rows, updates=31 * 4)
    weights, bias = plain_ftrl(rows, 4)
    assert np.flatnonzero(model.weights).tolist() == sorted(k for k, w in weights.items() if w)
    assert all(abs(model.weights[k] - w) < 1e-5 for k, w in weights.items()) and abs(model.bias - bias) < 1e-6


def test_sample_is_bounded(spark):
    """One row per doc_id however many bear it, rows and characters within their bounds, held-out rows never."""
    rows = [(1, f"text {i % 40} of one id") for i in range(3000)] + [(d, "word " * (d % 50)) for d in range(2, 400)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, rank int")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(400)], "doc_id long, quality int, toxic int")
    ids = {d for d in range(1, 400) if zlib.crc32(str(d).encode()) % 4 != 2}
    got = quality.sample(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(ids) and all((r.doc_id, r.text) in rows and r.quality == r.doc_id % 2 for r in got)
    few = quality.sample(docs, labels, most_rows=100, most_chars=5000).collect()
    assert 10 < len(few) < 130 and sum(len(r.text) for r in few) <= 5000
    order = [r.doc_id for r in sorted(got, key=lambda r: r.rank)]
    assert [r.doc_id for r in sorted(few, key=lambda r: r.rank)][:5] == order[:5]
    assert quality.fit(docs, labels).score("text 3 of one id") > 0.5


def test_odd_rows(spark):
    rows = [(1, "good plain words here", "x"), (2, "bad!! bad!! bad!!", "x"), (3, None, None), (4, "", "x"), (None, "good words", "x"), (1, "good plain words here", "x"), (7, "word " * 50000, "x"), (9, "good words", "x"), (10, "bad!! bad!!", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 1), (9, None, 0), (10, 0, 0), (77, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[1] > by[2] and by[3] == by[4] and sum(r.doc_id == 1 for r in got) == 2
    kept = quality.keep_good(docs, quality.Model(model.weights, 50.0))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs, labels.limit(0)).score("anything") == 0.5
    assert quality.fit(docs.limit(0), labels).score(None) == 0.5
