import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from chronoloom.llm import neardup, simhash
from chronoloom.llm.base import WordHashes

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def brute_keep(rows):
    """The doc_ids (here: distinct, not null) that name a component."""
    sets = {d: brute_set(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(d for d in ids if root[d] == d)


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    notice = " ".join(rng.choices(vocabulary, k=60))
    out = [None, "", " \n", "One", "one", "a b", "a b c d e", "A b  c d e"]
    for _ in range(30):
        base = rng.choices(vocabulary, k=rng.choice([8, 40, 120, 300]))
        for _ in range(rng.choice([1, 1, 4, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            own = own[rng.choice([0, 0, 3, len(own) // 9]) :]
            out.append(" ".join(own) + (" " + notice if rng.random() < 0.4 else ""))
    rng.shuffle(out)
    return list(enumerate(out))


def test_loses_nothing(spark):
    for seed, sample, common in ((1, 64, 8), (2, 1, 3), (3, 1, 2)):
        rows = texts(seed)
        expected = brute_keep(rows)
        assert 20 < len(expected) < len(rows) - 20
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, lang string")
        got = neardup.keep_one(df, sample=sample, common=common)
        assert got.columns == df.columns
        assert sorted(r.doc_id for r in got.collect()) == expected


def test_fingerprints_alone_link_close_copies(spark):
    """Two long texts but for a word: within two bits, and joined through their fingerprints; the verdict is the sets'."""
    base = [f"w{i}" for i in range(4000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(reversed(base))]
    rows = [neardup.shingle_set(t, WordHashes()) for t in texts]
    assert (neardup._fingerprint(rows[0]) ^ neardup._fingerprint(rows[1])).bit_count() <= 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = neardup._prefixes(docs, 64, 8)
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.min(F.struct("tie", "size", "prefix", "sim")).alias("own"))
    names = {r.fp: r["first"] for r in distinct.collect()}
    assert {frozenset((names[r.a], names[r.b])) for r in neardup._by_fingerprint(distinct).collect()} == {frozenset((0, 1))}


def test_stage_links_beyond_two_bits(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:30], "other", *base[31:]])), (3, " ".join(f"v{i}" for i in range(60)))]
    assert (simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).bit_count() > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [1, 3]


def test_odd_rows(spark):
    rows = [(None, None), (None, "only without an id"), (9, "x y z"), (9, "other text under the same id"), (10, "x y z"), (9, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in neardup.keep_one(df).collect()))) == sorted(map(str, [rows[0], rows[1], rows[2], rows[3]]))
    assert neardup.keep_one(df.limit(0)).count() == 0
