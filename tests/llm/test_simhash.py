import random
import re

import xxhash

from chronoloom.llm import simhash
from chronoloom.llm.queries import op10_simhash

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys):
    """keys: (name, fingerprint) rows -> component name by fingerprint."""
    fps = sorted({f for _, f in keys})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for name, f in keys:
        if name is not None:
            least[find(f)] = min(name, least.get(find(f), name))
    return {f: least.get(find(f)) for f in fps}


def signed(f):
    return f - (1 << 64) if f >= 1 << 63 else f


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        rows = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
        own = brute_components(rows)
        got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in op10_simhash(spark, sf).collect())
        assert got == sorted((d, f"{f:016x}", own[f]) for d, f in rows)


def clusters(seed):
    rng = random.Random(seed)
    out = set()
    for _ in range(25):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):
            out.add(f)
            for _ in range(rng.choice([1, 2, 2, 3])):
                f ^= 1 << rng.randrange(64)
    low, high = rng.getrandbits(32), rng.getrandbits(32) << 32
    for _ in range(40):  # values of a segment that many share
        out.add(high | (low ^ 1 << rng.randrange(32) ^ 1 << rng.randrange(32)))
        out.add(low | (high ^ (1 << rng.randrange(32, 64)) ^ (1 << rng.randrange(32, 64))))
        out.add((high ^ 1 << 40) | (low ^ 1 << rng.randrange(32)))
    return out | {0, 1, 3, (1 << 64) - 1}


def test_links_lose_nothing(spark):
    for seed, hot in ((1, 4), (2, 64), (3, 1)):
        fps = clusters(seed)
        df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        got = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, hot=hot).collect()]
        expected = {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
        assert {frozenset(x) for x in got} == expected and len(got) == len(expected)


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 300, 1) if i % 60] + [(1000, 1000 + i) for i in range(200)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    texts = [None, "", " \n\t", "One", "one", "a b", "A  b\x0b", "a b c", "a b c " * 20000, "x y z", "x y z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None), (None, "only without an id"), (9, "x y z"), (9, "other text under the same id")]
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, fingerprint long, component_id long")
    got = simhash.near_duplicates(df).collect()
    fps = [(d, brute_fingerprint(t)) for d, t in rows]
    own = brute_components(fps)
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(str((d, f"{f:016x}", own[f])) for d, f in fps)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    assert ids == sorted([*{str(d) for d, f in fps if d == own[f]}, "9"])  # two components are named 9
    assert simhash.near_duplicates(df.limit(0)).count() == 0
