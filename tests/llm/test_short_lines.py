import random

import corpus_pipeline
from chronoloom.llm import lines
from tests.llm.test_lines import near


def brute(docs):
    """docs in order; blank lines stay, lines under 20 characters go by equality, others within one edit."""
    seen, out = {}, []
    for d, t in docs:
        kept = []
        for x in t.split("\n"):
            n = x.strip(" \t\r").lower()
            if not n or not (n in seen or (len(n) >= 20 and any(len(s) >= 20 and near(n, s) for s in seen))):
                kept.append(x)
            if n:
                seen[n] = True
        out.append((d, "\n".join(kept), t.count("\n") + 1, len(kept)))
    return out


def test_short_lines_go_by_equality(spark):
    rng = random.Random(3)
    base = ["", " ", "Home", "home ", "Hom", "a", "Haanth.", "x" * 19, "x" * 20, "x" * 18 + "yx", "x" * 18 + "y"] + ["".join(rng.choices("ab", k=k)) for k in (5, 18, 19, 20, 21, 21)]
    docs = [(d, "\n".join(rng.choice(base) + rng.choice(["", "", "b"]) for _ in range(rng.randrange(1, 6)))) for d in range(60)]
    got = sorted((r.doc_id, r.text, r["__lines"], r["__kept"]) for r in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string"), exact_chars=1).collect())
    assert got == brute(docs)


def test_stage_leaves_no_wrecks(spark):
    body = "this line is long enough and stands in both"
    docs = [(1, f"Haanth.\n{body}\n"), (2, f"{body}\n\nhaanth. "), (3, "\n\n"), (4, None), (5, ""), (6, f"{body}\nOwn")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in docs], "doc_id long, text string, n_chars long")
    got = sorted(tuple(r) for r in corpus_pipeline.line_stage(spark, df, "").collect())
    assert got == [(1, docs[0][1], len(docs[0][1])), (3, "\n\n", 2), (4, None, 0), (5, "", 0), (6, "Own", 3)]
