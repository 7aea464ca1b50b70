"""URL filters: given rules by host and path, and association rules mined from labels."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batch, map_batches

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BAD = "label=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #. None: both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and the url's tokens, each with its place: host names (h:), and pieces of them between hyphens;
    path words (p:) and what file type the path ends in (t:); names (q:) and pairs (v:) of the query. Bare numbers are none.
    """
    host, path = host_and_path(F.col("__url"))
    query = F.coalesce(F.regexp_extract("__url", r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("__url")).select("page_id", host.alias("host"), path.alias("path"), F.lower(query).alias("__query"))
    mark = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind), x))
    names = F.split("host", r"\.")
    pieces = F.filter(F.split("host", r"[.-]"), lambda x: ~F.array_contains(names, x))
    words = F.split(F.lower("path"), r"[^a-z0-9\x{80}-\x{10ffff}]+")
    kind = F.regexp_extract(F.lower("path"), r"\.([a-z0-9]{1,8})$", 1)
    pairs = F.filter(F.split("__query", "&"), lambda x: F.length(x) > 0)
    tokens = F.array_distinct(F.concat(mark("h:", names), mark("h:", pieces), mark("p:", words), mark("t:", F.array(kind)), mark("q:", F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1)))), mark("v:", pairs)))
    keep = F.filter(tokens, lambda x: (F.length(x) > 2) & ~x.rlike(r"^[hpt]:\d+$"))
    return split.select("page_id", "host", "path", keep.alias("tokens"))


def lower_bound(share: float, n: float, z: float) -> float:
    """The lower end of Wilson's interval of a share seen in n cases, ``z`` standard deviations wide."""
    centre, spread = share + z * z / (2 * n), z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return (centre - spread) / (1 + z * z / n)


def mine(pages: DataFrame, labels: DataFrame, *, min_support: float = 0.0005, min_pages: int = 20, min_confidence: float = 0.0, min_lift: float = 1.1, z: float = 2.0) -> list[tuple[frozenset[str], float, float]]:
    """Token combinations that go with bad labels (quality 0 or toxic 1), as (tokens, confidence, support).

    FP-growth runs on the labelled pages (page_id = doc_id; a page with several label rows counts once, bad if any
    is). A combination is a rule if ``min_pages`` labelled pages bear it, its bad ones are ``min_support`` of all, its
    confidence is at least ``min_confidence`` and ``min_lift`` times the share of bad pages among all, and Wilson's lower
    bound of that confidence (``z``) lies above that share: so few labels, or chance at that width, prove nothing. A
    rule is dropped if a subset of its tokens has as high a confidence. Combinations may have any number of tokens.
    What comes to the driver is bounded by the support, a share, whatever the table's size. No labelled page, or none
    that is bad: no rules.
    """
    from pyspark.ml.fpm import FPGrowth

    bad = labels.select(F.col("doc_id").cast("long").alias("page_id"), F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"), F.lit(0)).alias("bad"), F.coalesce("quality", "toxic").alias("any")).where("any is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    baskets = parts(pages).join(bad, "page_id").select("bad", F.when(F.col("bad") == 1, F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    count, total = baskets.agg(F.count("*"), F.sum("bad")).first()
    if count < min_pages or not total:
        return []
    base = total / count
    least = min(1.0, max(min_confidence, min_lift * base))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=least).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BAD)).select("antecedent", "confidence", "support").collect()
    rules: list[tuple[frozenset[str], float, float]] = []
    for r in sorted(found, key=lambda r: (len(r.antecedent), sorted(r.antecedent))):
        tokens, n = frozenset(r.antecedent), r.support * count / r.confidence
        if n < min_pages - 1e-6 or lower_bound(r.confidence, n, z) <= base:
            continue
        if not any(t < tokens and c >= r.confidence for t, c, _ in rules):
            rules.append((tokens, r.confidence, r.support))
    return rules


class Rules:
    """Given rules by host; mined rules by an inverted index from token to rule."""

    def __init__(self, given: tuple[tuple[str, str, str], ...], mined: list[tuple[frozenset[str], float, float]]) -> None:
        self.given: dict[str, list[tuple[str, str]]] = defaultdict(list)
        for verdict, host, path in given:
            self.given[host].append((path, verdict))
        self.mined = mined
        self.index: dict[str, list[int]] = defaultdict(list)
        for i, (tokens, _, _) in enumerate(mined):
            for t in tokens:
                self.index[t].append(i)

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest given rule (host and path together) of this host or a parent of it, and its verdict."""
        best, names = None, host.split(".")
        for k in range(len(names)):
            parent = ".".join(names[k:])
            for start, verdict in self.given.get(parent, ()):
                if path.startswith(start) and (best is None or len(parent) + len(start) > len(best[0])):
                    best = (parent + start, verdict)
        return best

    def match(self, tokens: list[str]) -> tuple[float, frozenset[str] | None]:
        """The highest confidence of a mined rule all of whose tokens are here, and those tokens; else 0."""
        hits = Counter(i for t in set(tokens) for i in self.index.get(t, ()))
        best = max((i for i, n in hits.items() if n == len(self.mined[i][0])), key=lambda i: (self.mined[i][1], -i), default=None)
        return (self.mined[best][1], self.mined[best][0]) if best is not None else (0.0, None)


OUT = "page_id long, host string, path string, rule string, verdict string, confidence double, mined_rule string"
_OUT = pa.schema([("page_id", pa.int64()), *((n, pa.string()) for n in ("host", "path", "rule", "verdict")), ("confidence", pa.float64()), ("mined_rule", pa.string())])


def judge(pages: DataFrame, labels: DataFrame, given: tuple[tuple[str, str, str], ...] = RULES, **mining) -> DataFrame:
    """A verdict for each row of ``pages(page_id, url)``: a given rule's, else block if a mined rule matches, else allow.

    ``mined_rule`` and ``confidence`` name the mined rule of highest confidence that matches (null and 0: none), also
    where a given rule decides.
    Null url or no ``://``: host and path empty, no rule. Null page_id and repeated rows are kept. Empty tables: no
    rows, or no mined rules. Other columns (the page itself) are never read. Texts of any length pass whole.
    """
    rules = Rules(given, mine(pages, labels, **mining))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for page, host, path, tokens in zip(*(c.to_pylist() for c in b.columns)):
                own, (confidence, mined) = rules.rule(host, path), rules.match(tokens or [])
                rows.append((page, host, path, own and own[0], own[1] if own else "block" if mined else "allow", confidence, " ".join(sorted(mined)) if mined else None))
            if rows:
                yield batch(_OUT, dict(zip(_OUT.names, map(list, zip(*rows)))))

    return map_batches(parts(pages), run, OUT)
