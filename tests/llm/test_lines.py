import random

from chronoloom.llm import lines
from chronoloom.llm.queries import op9_line_dedup


def near(a, b):
    """Within one inserted, deleted or replaced character."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i + 1 :] == b[i + 1 :] or a == b


def brute(docs, least=20, exact=None):
    """docs in order; the text each keeps. Lines under ``least`` characters go by equality, from ``exact`` characters on."""
    seen, out = {}, []
    for d, t in docs:
        if t is None:
            out.append((d, None, 0, 0))
            continue
        own, kept = t.split("\n"), []
        for x in own:
            n = x.strip(" \t\r").lower()
            if len(n) < (least if exact is None else exact):
                kept.append(x)
                continue
            if not (n in seen or len(n) >= least and any(len(s) >= least and near(n, s) for s in seen)):
                kept.append(x)
            seen[n] = True
        out.append((d, "\n".join(kept), len(own), len(kept)))
    return out


def run(df, **how):
    return sorted(((r.doc_id, r.text, r["__lines"], r["__kept"]) for r in lines.dedup(df, **how).collect()), key=str)


def test_random_lines_against_brute_force(spark):
    rng = random.Random(11)
    base = ["".join(rng.choices("ab é", k=rng.choice([19, 20, 21, 25, 40]))) + str(i) for i in range(40)]

    def edit(x):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(x))
            x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abzé") + x[i:], x[:i] + rng.choice("abzé") + x[i + 1 :]])
        return x

    docs = [(d, "\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 8)))) for d in range(80)]
    expected = brute(docs)
    assert sum(k < n for _, _, n, k in expected) > 30
    assert run(spark.createDataFrame(docs, "doc_id long, text string")) == sorted(expected, key=str)


def test_hot_keys(spark):
    """Keys that are split off and broadcast (here: of three rows and more) give the same rows."""
    docs = [(d, f"line {d % 9} that many documents have, or nearly so\nand one of its own: {d * d * 7919}\nshort\n\nline {d % 4}") for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for exact in (None, 1):
        assert run(df, hot=2, exact_chars=exact) == run(df, exact_chars=exact) == sorted(brute(docs, exact=exact), key=str)


def test_names_of_other_columns(spark):
    names = ["doc", "tie", "pos", "drop", "split", "row", "key", "__doc", "__tie", "__drop", "__split", "__text", "__lines", "__kept", "n", "all"]
    df = spark.createDataFrame([(1, "a line that is long enough to go\na line that is long enough to go", *names)], "doc_id long, text string, " + ", ".join(f"`{x}` string" for x in names))
    out = lines.dedup(df)
    assert out.columns == [c for c in df.columns if c not in ("__lines", "__kept")] + ["__lines", "__kept"]
    r = out.first()
    assert r.text == "a line that is long enough to go" and (r["__lines"], r["__kept"]) == (2, 1) and all(r[c] == c for c in names if c not in ("__lines", "__kept"))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    import hashlib

    got = sorted((r.doc_id, r.n_lines, r.n_kept, r.kept_md5) for r in op9_line_dedup(spark, sf).collect())
    assert got == [(d, n, k, hashlib.md5(t.encode()).hexdigest()) for d, t, n, k in brute(docs, exact=1)]


def test_hot_variants(spark):
    """Thousands of lines that all share a variant: none is lost, no pairs are made."""
    docs = [(d, f"this is item number {d % 10} of a very long list\nthis is item number {d % 10}{d % 7} of a very long list") for d in range(3000)]
    got = run(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sum(r[3] for r in got) == 1 and (0, "this is item number 0 of a very long list", 2, 1) in got


def test_odd_rows(spark):
    long = "x" * 30 + " word" * 20000
    docs = [(1, None), (2, ""), (3, "\n\n"), (4, "short\nshort\nshort"), (5, "a line that is long enough, yes\n  A LINE that is long enough, yes\t\r\na line that is long enough, yet\na line that is long enough yes"), (6, long), (7, long[:-1] + "t"), (8, "every line here repeats a line\nEvery line here repeats a line"), (9, "every line here repeats a line")]
    df = spark.createDataFrame([(t, d, 1, 2) for d, t in docs] + [("no id but a line that is long enough, yes", None, 1, 2)], "text string, doc_id long, n long, line int")
    got = run(df)
    assert got == sorted([*brute(docs), (None, "no id but a line that is long enough, yes", 1, 1)], key=str)
    assert lines.dedup(df).columns == ["text", "doc_id", "n", "line", "__lines", "__kept"]
    assert lines.dedup(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "one line that is long enough here\none line that is long enough here")] * 2, "doc_id long, text string")
    assert [r.text for r in lines.dedup(twice).collect()] == ["one line that is long enough here"] * 2


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")
    assert "Python" not in lines.dedup(df)._jdf.queryExecution().executedPlan().toString()
