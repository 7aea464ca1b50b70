import random

from chronoloom.llm import decontaminate
from chronoloom.llm.queries import op8_decontamination


def shingles(text):
    w = decontaminate.words(text)
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute(docs, items):
    found = {}
    for d, t in docs:
        for i, x in items:
            own = shingles(x)
            if own:
                n = len(next(iter(own)))
                w = decontaminate.words(t)
                there = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
                share = len(own & there) / len(own)
                if share >= 0.8:
                    found[i, d] = max(share, found.get((i, d), 0))
    return found


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        read = lambda t, k: [(r[k], r["text"]) for r in spark.read.parquet(f"{sf}/{t}.parquet").collect()]  # noqa: B023, E731
        got = {(r.item_id, r.doc_id): r.containment for r in op8_decontamination(spark, sf).collect()}
        assert got == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert got


def test_edited_passages_and_odd_rows(spark):
    rng = random.Random(3)
    vocabulary = ["w%d" % i for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 5, 8, 20, 40, 90])))) for i in range(60)] + [(60, None), (61, "!!"), (None, "nobody here has an id at all"), (7, "twice the same id with another text inside")]
    docs = []
    for d in range(120):
        body = rng.choices(vocabulary, k=rng.choice([0, 10, 3000]))
        for _ in range(rng.randrange(3)):
            own = (rng.choice(items[:60])[1]).split()
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = "changed"
            at = rng.randrange(len(body) + 1)
            body[at:at] = own
        docs.append((d, " ".join(x.upper() if rng.random() < 0.3 else x for x in body)))
    docs += [(200, None), (201, ""), (None, "well NOBODY here, has an id -- at all."), (0, docs[0][1]), (1, "repeated id " + items[0][1])]
    df = spark.createDataFrame([(*x, "q") for x in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    expected = brute(docs, items)
    assert len(expected) > 40 and any(v < 1 for v in expected.values())
    for block in (10**6, 50):
        got = {(r.item_id, r.doc_id): r.containment for r in decontaminate.find(df, bench, block_words=block).collect()}
        assert got == expected
    bad = {d for _, d in expected}
    kept = decontaminate.drop_contaminated(df, bench, block_words=50)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(d) for d, t in docs if not brute([(d, t)], items))
    assert None in bad
    assert decontaminate.find(df.limit(0), bench).count() == 0
    assert decontaminate.find(df, bench.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_partitions_have_their_own_bounds():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices([f"w{j}" for j in range(500)], k=k))) for i, k in enumerate([5, 6, 7, 12, 13, 40, 41, 200, 3])]
    index = decontaminate.Index(items)
    assert sorted(index.partitions) == [3, 5] and len(index.partitions[5]) > 3
    assert len({int(p.threshold) for p in index.partitions[5]}) == len(index.partitions[5])
    for p in index.partitions[5]:
        own = {int(o) for o in p.owner}
        assert p.threshold == max(p.keys) and p.least == min(-(-4 * len(index.items[i][1]) // 5) for i in own)
