import itertools
import random
import re

from chronoloom.llm import licenses
from chronoloom.llm.license_texts import TEXTS
from chronoloom.llm.queries import op1_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    own, found = words(text), []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
    return len(own), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def rows_of(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in df.collect()]


def test_query_against_brute_force(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        got = rows_of(op1_licenses(spark, sf))
        assert len(got) == len(texts) and all(base(texts[d]) == x for d, x in got)
        assert any(x[1] for _, x in got)


ODD = [
    None, "", "Under the MIT License under the mit license", "released UNDER-THE_mit/license, (Apache License; Version 2.0) CC BY-NC-4", "cc by cc by nc by nc", "under the mit licenseé",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this softwarez and associated documentation files (the \"Software\")",
    "permission is hereby denied free of charge to any person obtaining a copy of this software and associated documentation files", "w " * 30000 + "cc by nc", "All Rights Reserved.",
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(ODD)] + [(None, ODD[2], 0), (2, ODD[2], 0)], "doc_id long, text string, n_words long")
    got = licenses.scan(df).collect()
    assert len(got) == len(ODD) + 2
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(ODD):
        assert (by[i].n_words, by[i].n_base, by[i].first_word, by[i].last_word, by[i].base_labels) == base(t), t
    assert by[3].base_labels == "apache-2,cc-by-nc,mit"
    assert by[6].labels == "mit" and 0.8 <= by[6].score < 1.0 and by[6].base_labels == ""
    assert by[7].labels == ""  # its key phrase is missing
    assert by[9].labels == "all-rights-reserved"
    assert licenses.scan(df.limit(0)).count() == 0


def test_words_in_order_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        t, w = rng.choices([b"a", b"b", b"c", b"d"], k=rng.randrange(1, 12)), rng.choices([b"a", b"b", b"c", b"e"], k=rng.randrange(0, 14))
        places = {}
        for q, x in enumerate(t):
            places[x] = places.get(x, 0) | 1 << q
        row = [0] * (len(t) + 1)
        for x in w:
            row = [0, *itertools.accumulate(range(1, len(t) + 1), lambda best, q, x=x, row=row: max(best, row[q], row[q - 1] + (t[q - 1] == x)), initial=0)][1:]
        assert licenses.in_order(w, places) == row[-1]


def test_templates_find_themselves():
    index = licenses.Index(licenses.PHRASES, licenses.TEMPLATES, {})
    for i, words_ in enumerate(index.words):
        base_, own = index.find([b"x", *words_, b"y"])
        assert (i, 1) in base_ or (i, 1, 1.0) in own
        base_, own = index.find([*words_, *[b"z"] * 400, *words_])
        assert sum(x[0] == i for x in (*base_, *own)) >= 2


def edited(rng, words_, kind, n, keep):
    """n words inserted, deleted or replaced, none inside the key phrases."""
    out, free = list(words_), [p for p in range(len(words_)) if p not in keep]
    for p in sorted(rng.sample(free, n), reverse=True):
        if kind == "insert" and not (p in keep or p - 1 in keep):
            out.insert(p, b"other")
        elif kind == "delete":
            del out[p]
        else:
            out[p] = b"other"
    return out


def test_recall_under_edits():
    """One or two words put in, left out or changed, outside the key phrases: 0.9 and more of the places are found."""
    index, rng = licenses.Index(licenses.PHRASES, licenses.TEMPLATES, {}), random.Random(1)
    for kind in ("insert", "delete", "replace"):
        for n in (1, 2):
            found = total = 0
            for i, t in enumerate(index.words):
                if i < index.n_phrases or len(t) < 12:
                    continue
                keep = {p + j for k in index.keys[i] for p in range(len(t) - len(k) + 1) if t[p : p + len(k)] == k for j in range(len(k))}
                for _ in range(20):
                    text = [b"before", *edited(rng, t, kind, n, keep), b"after", *rng.choices([b"of", b"the", b"license", b"in", b"w"], k=60)]
                    total += 1
                    found += any(x[0] == i for x in index.find(text)[1])
            assert found >= 0.9 * total, (kind, n, found, total)


def test_rare_words_are_those_of_the_file():
    t = (licenses.Template("x", "one two three four five six seven eight nine ten", ("three four",)),)
    idf = {w.encode(): float(len(w)) for w in t[0].text.split()}
    index = licenses.Index((), t, idf)
    assert index._anchors(0, set(index.words[0])) == [b"eight", b"seven", b"three", b"five", b"four", b"nine"]
    assert index._anchors(0, set(index.words[0]) - {b"seven", b"nine"}) == [b"eight", b"three", b"five", b"four", b"one", b"six"]
    assert index._anchors(0, {b"one", b"two"}) == []


def test_labels_of_the_method(spark):
    """Whole licence texts with edits among invented prose; texts without one get no label beyond the base ones."""
    rng = random.Random(3)
    prose = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    rows, expected = [], {}
    for i, (label, text, keys) in enumerate(x for x in TEXTS if len(x[1].split()) >= 12):
        w = text.split()
        p = rng.choice([p for p in range(1, len(w)) if not any(w[p] in k.split() for k in keys)])
        rows.append((i, f"{prose[i]} {' '.join(w[:p]).title()}, {' '.join(w[p + 1:])}.\n{prose[i + 1]}", 0))
        expected[i] = label
    rows += [(1000 + i, t, 0) for i, t in enumerate(prose)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, labels long")).collect()}
    for i, label in expected.items():
        assert label in got[i].labels.split(",") and got[i].score >= 0.8 and any(s.label == label for s in got[i].spans), rows[i]
    known = {"all-rights-reserved"}
    for i in range(1000, 1000 + len(prose)):
        assert set(got[i].labels.split(",")) - known <= set(got[i].base_labels.split(",")) | {""}, (got[i], rows[i - 1000 + len(expected)])
