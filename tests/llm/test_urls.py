import itertools
import re
from collections import Counter

from chronoloom.llm import urls
from chronoloom.llm.queries import op3_url_filter


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :], re.S)[0]


def rule(host, path):
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


ODD = [None, "", "no scheme.com/en/", "http://", "HTTP://A.Example.COM/en/7x?y#z", "x://COM/en/", "x://acom/en/", "https://example.net?q=/de/", "http://u@h.net:80/de/8#://b", "http://é.org/es/\nline?x", "a://b://c.com/en/", "http://x.net/de/" + "a" * 50000, "http://..com/en/1", "ftp://İ.COM/en/"]


def test_given_rules(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD)] + [(None, ODD[4], "x"), (4, ODD[4], "x")], "page_id long, url string, host string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = urls.judge(df, empty).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        if r.page_id is not None:
            host, path = split(ODD[r.page_id])
            own = rule(host, path)
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, own and own[0], own[1] if own else "allow"), ODD[r.page_id]
    assert urls.judge(df.limit(0), empty).count() == 0


def test_verdicts_of_the_given_rules(spark):
    """The contract's words, written out here on their own."""
    words = {"block": ["x://com/en/", "x://a.com/en/1", "x://example.net/de/8", "x://a.example.net/de/80", "x://b.org/es/"], "allow": ["x://example.com/en/7", "x://a.example.com/en/71", "x://net/de/", "x://a.net/de/8", "x://example.net/de/9"]}
    want = {u: verdict for verdict, urls_ in words.items() for u in urls_}
    df = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = urls.judge(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {u: next(r.verdict for r in got if r.page_id == i) for i, u in enumerate(want)} == want and all(r.rule for r in got)


def test_mined_rules_against_brute_force(spark):
    pages = [(i, f"http://{'spam' if i % 5 == 0 else 'good'}.example.xyz/{'shop' if i % 2 else 'news'}/{i}") for i in range(200)]
    labels = [(i, 0 if i % 10 == 5 else 1, None if i % 3 else 0) for i in range(150)] + [(None, 0, 0), (9999, 0, 1), (5, 1, 0)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = urls.mine(df, lab, min_support=0.05, min_pages=5, min_confidence=0.9)
    assert (frozenset({"h:spam", "p:shop"}), 1.0) in [(t, c) for t, c, _ in rules]
    baskets = {r.page_id: set(r.tokens) for r in urls.parts(df).collect()}
    bad = {i for i, q, t in labels[:150] if q == 0}
    for tokens, confidence, support in rules:
        have = [i for i in range(150) if tokens <= baskets[i]]
        assert abs(confidence - len(bad.intersection(have)) / len(have)) < 1e-9 and confidence >= 0.9
        assert abs(support - len(bad.intersection(have)) / 150) < 1e-9 and support >= 0.05
    got = {r.page_id: r.verdict for r in urls.judge(df, lab, min_support=0.05, min_pages=5, min_confidence=0.9).collect()}
    assert all((got[i] == "block") == any(t <= baskets[i] for t, _, _ in rules) for i in got)
    assert urls.mine(df, lab.where("quality = 1 and coalesce(toxic, 0) = 0")) == [] == urls.mine(df.limit(0), lab)
    assert got[195] == "block" and got[190] == "allow"  # pages without labels, too


def tokens_of(url):
    host, path = split(url)
    lower = lambda x: x.lower()
    names = host.split(".")
    words = re.split("[^a-z0-9\x80-\U0010ffff]+", lower(path))
    kind = re.search(r"\.([a-z0-9]{1,8})$", lower(path))
    query = re.match(r"[^?#]*\?([^#]*)", url or "", re.S)
    pairs = [x for x in lower(query[1] if query else "").split("&") if x]
    out = {"h:" + x for x in names} | {"h:" + x for x in re.split("[.-]", host)} | {"p:" + x for x in words} | {"q:" + x.split("=")[0] for x in pairs} | {"v:" + x for x in pairs}
    if kind:
        out.add("t:" + kind[1])
    return {x for x in out if len(x) > 2 and not re.fullmatch(r"[hpt]:\d+", x)}


def test_query(spark):
    """Whole verdicts; the mined rules themselves, of one and two tokens, against counts over all labelled pages."""
    sf = "/root/testdata/sf0.1"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    labels = {r.doc_id: int(r.quality == 0 or r.toxic == 1) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    tokens = {p: tokens_of(u) for p, u in pages.items()}
    seen = [p for p in pages if p in labels]
    share = sum(labels[p] for p in seen) / len(seen)
    rules = {t: c for t, c, _ in urls.mine(spark.read.parquet(f"{sf}/pages.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))}
    have, bad = Counter(), Counter()
    for p in seen:
        for k in (1, 2):
            for c in itertools.combinations(sorted(tokens[p]), k):
                have[frozenset(c)] += 1
                bad[frozenset(c)] += labels[p]
    expected = {}
    for t in sorted(have, key=len):
        c = bad[t] / have[t]
        if have[t] >= 20 and c >= 1.1 * share and urls.lower_bound(c, have[t], 2.0) > share and not any(x < t and y >= c - 1e-12 for x, y in expected.items()):
            expected[t] = c
    assert {t for t in rules if len(t) < 3} == expected.keys() and expected and all(abs(rules[t] - c) < 1e-9 for t, c in expected.items())
    got = op3_url_filter(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = split(pages[r.page_id])
        own = rule(host, path)
        best = max((c for t, c in rules.items() if t <= tokens[r.page_id]), default=0.0)
        assert (r.host, r.path, r.rule, r.confidence) == (host, path, own and own[0], best)
        assert r.verdict == (own[1] if own else "block" if best else "allow")
    assert any(r.mined_rule and not r.rule for r in got)
