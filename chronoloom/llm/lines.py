"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import join_hot, materialize

#: Shorter lines (after trimming) have no near lines: one edit is too much of them. ``exact_chars`` bounds the exact step.
LEAST_CHARS = 20
#: Blocks of the second filter: about a word's length in a line of a few hundred characters.
FINE = 64


def normal(line: Column) -> Column:
    """What lines are compared by: without spaces, tabs and carriage returns at their ends, lower-cased."""
    return F.lower(F.btrim(line, F.lit(" \t\r")))


def _document() -> tuple[Column, Column]:
    """A document's place in order, and a hash of its text for equal doc_ids; null doc_ids come last."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc"), F.xxhash64("text").alias("tie")


def _exploded(docs: DataFrame) -> DataFrame:
    """Every line with its place (document, its tie-breaker, number)."""
    rows = docs.select(*_document(), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc", "tie", "pos", normal(F.col("line")).alias("n")).withColumn("len", F.length("n"))


def _key(n: Column) -> Column:
    """128 bits, so that distinct lines of a very large corpus keep distinct keys."""
    return F.struct(F.xxhash64(n).alias("x"), F.xxhash64(n, F.lit("line")).alias("y"))


def _without(n: Column, length: Column, at: Column | int, of: int) -> Column:
    """A hash of the line without block ``at`` of ``of``; blocks are cut as a line of ``length`` characters is.

    Two lines within one edit are equal but for one block, if both are cut as the shorter one is: each line gives the
    hashes for its own length, and those for one character less. (The column len is the line's length.)
    """
    start, end = F.floor(length * at / of), F.floor(length * (at + 1) / of)
    return F.xxhash64(length, F.lit(at) if isinstance(at, int) else at, F.left(n, start), F.substring(n, F.col("len") - (length - end) + 1, length - end))


def _sharing(lines: DataFrame, hashes: Column, hot: int) -> DataFrame:
    """The keys of those distinct ``lines(key, ...)`` that share one of ``hashes`` (an array) with a different line."""
    each = materialize(lines.select("key", F.explode(hashes).alias("hash")), "hashes")
    shared = materialize(each.groupBy("hash").agg(F.min("key.x").alias("lo"), F.max("key.x").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("hash", "n"), "shared-hashes")
    return join_hot(each, shared, "hash", "n", each.count(), hot).select("key").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """The deletion neighbourhood of ``lines(key, place, n, len)`` for one edit, as hashed keys.

    Each line gives itself (kind 0, hash of the whole), itself less each character (kind 1, the same key space), and
    itself with each place left open (kind 2: length and place are in the key). Lines that share a kind-2 key differ
    in that one place; a kind-1 key equal to a kind-0 key is one deletion. A variant's hash is the exclusive or of the
    64-bit hashes of its (place, character) pairs, so that a line costs one pass however long it is: leaving place i
    open takes its hash off; deleting it also moves the places behind it down by one. Running values come from a
    window over the line's characters, in bounded memory.
    """
    h = lambda at: F.xxhash64(at, F.col("c"))
    chars = lines.select("key", "place", "len", F.posexplode(F.split("n", "")).alias("i", "c")).select("key", "place", "len", "i", h(F.col("i")).alias("h"), h(F.col("i") - 1).alias("less"))
    line = Window.partitionBy("key")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = chars.select("*", F.bit_xor("h").over(upto).alias("s"), F.bit_xor("less").over(upto).alias("s_less"), F.bit_xor("h").over(line).alias("t"), F.bit_xor("less").over(line).alias("t_less"))
    # characters before i keep their places, those behind move down by one
    deleted = F.col("s").bitwiseXOR(F.col("h")).bitwiseXOR(F.col("t_less")).bitwiseXOR(F.col("s_less"))
    variant = lambda kind, size, at, k: F.struct(F.lit(kind).alias("kind"), size.alias("size"), at.alias("at"), k.alias("k"))
    own = [variant(1, F.col("len") - 1, F.lit(-1), deleted), variant(2, F.col("len"), F.col("i"), F.col("t").bitwiseXOR(F.col("h")))]
    each = F.when(F.col("i") == 0, F.array(variant(0, F.col("len"), F.lit(-1), F.col("t")), *own)).otherwise(F.array(*own))
    return run.select("key", "place", F.explode(each).alias("v")).select("key", "place", "v.*")


def near_earlier(lines: DataFrame) -> DataFrame:
    """Of distinct ``lines(key, place, n, len)``: (key, other), other being the key of an earlier line within one edit.

    Variants meet by equal keys, and only the earliest place of each kind is kept per key, by partial aggregates: a
    key that very many lines share makes no pairs and gathers no group. Whichever of a line's keys gives a still
    earlier line gives a true neighbour, so the earliest suffices.
    """
    v = materialize(_variants(lines).withColumn("space", F.when(F.col("kind") == 2, 2).otherwise(1)), "variants")
    by = ["space", "size", "at", "k"]
    first = lambda kind: F.min(F.when(F.col("kind") == kind, F.struct("place", "key"))).alias(f"m{kind}")
    # a key meets nobody unless two lines have it: a check on plain longs goes before the one on places
    shared = v.groupBy(*by).agg(F.min("key.x").alias("lo"), F.max("key.x").alias("hi")).where("lo <> hi").select(*by)
    v = materialize(v.join(shared, by, "left_semi"), "shared-variants")
    least = v.groupBy(*by).agg(first(0), first(1), first(2))
    met = v.join(least, by).withColumn("m", F.when(F.col("kind") == 0, F.col("m1")).when(F.col("kind") == 1, F.col("m0")).otherwise(F.col("m2")))
    return met.where(F.col("m.place") < F.col("place")).groupBy("key").agg(F.min("m").alias("m")).select("key", F.col("m.key").alias("other"))


def duplicates(docs: DataFrame, *, least_chars: int = LEAST_CHARS, exact_chars: int | None = None, hot: int = 100_000) -> DataFrame:
    """(doc, tie, drop): the numbers of the lines of each text that an earlier line repeats, exactly or within one edit.

    Before the neighbourhoods are made, two filters that lose nothing leave the lines that can have a neighbour: by
    halves over all distinct lines, by all but one of FINE blocks over what that leaves. Texts of those lines are read
    from where each first stands. Nothing is broadcast but hot keys, at most HOT_SHARE of them (``hot``: see join_hot).
    """
    n, length, place = F.col("n"), F.col("len"), F.struct("doc", "tie", "pos")
    exploded = _exploded(docs).where(F.col("len") >= (least_chars if exact_chars is None else exact_chars))
    halves = F.array(*[_without(n, length - less, at, 2) for less in (0, 1) for at in (0, 1)])
    halves = [F.when(length >= least_chars, h).alias(f"h{i}") for i, h in enumerate(F.get(halves, i) for i in range(4))]
    lines = materialize(exploded.select("doc", "tie", "pos", _key(n).alias("key"), *halves), "lines")
    total = lines.count()
    distinct = materialize(lines.groupBy("key").agg(F.min(place).alias("place"), F.count("*").alias("n"), *[F.min(f"h{i}").alias(f"h{i}") for i in range(4)]), "distinct-lines")

    likely = _sharing(distinct.where("h0 is not null"), F.array("h0", "h1", "h2", "h3"), hot)
    by_text = likely.join(distinct, "key").groupBy("place.doc", "place.tie").agg(F.collect_set("place.pos").alias("at"))
    doc, tie = _document()
    found = docs.where("text is not null").select("text", doc, tie).join(by_text, ["doc", "tie"]).withColumn("all", F.split("text", "\n"))
    texts = found.select("doc", "tie", F.explode(F.transform("at", lambda i: F.struct(i.alias("pos"), normal(F.get("all", i)).alias("n")))).alias("l")).select("doc", "tie", "l.*")
    texts = materialize(texts.select(_key(n).alias("key"), place.alias("place"), "n", F.length("n").alias("len")).dropDuplicates(["key"]), "likely-texts")
    parts = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda at: F.array(_without(n, length, at, FINE), _without(n, length - 1, at, FINE))))
    texts = materialize(texts.join(_sharing(texts, parts, hot), "key", "left_semi"), "near-texts")

    pairs = near_earlier(texts)
    own, other = texts.select("key", n.alias("n1")), texts.select(F.col("key").alias("other"), n.alias("n2"))
    near = materialize(pairs.join(own, "key").join(other, "other").where(F.levenshtein("n1", "n2", 1).between(0, 1)).select("key", F.lit(True).alias("near")), "near")
    # a line's first place goes too if it is near an earlier line; all later places go in any case
    state = materialize(distinct.select("key", F.col("place").alias("first"), "n").join(near, "key", "left").where("n > 1 or near"), "repeated")
    gone = join_hot(lines.select("key", "doc", "tie", "pos"), state, "key", "n", total, hot).where(F.col("near") | (place != F.col("first")))
    return gone.groupBy("doc", "tie").agg(F.collect_set("pos").alias("drop"))


def dedup(docs: DataFrame, *, least_chars: int = LEAST_CHARS, exact_chars: int | None = None, hot: int = 100_000) -> DataFrame:
    """``docs`` with repeated lines taken out of their texts: all columns, and ``__lines``, ``__kept`` (their numbers).

    A line (split at line feeds; compared without blanks at its ends, lower-cased) goes if an equal line, or one within one inserted,
    deleted or replaced character, stands earlier, in the order of doc_id, text hash and line number; that earlier
    line needs not be kept itself. Lines shorter than ``least_chars`` go only if an equal one stands earlier and they
    have ``exact_chars`` at least (1: all but blank lines; None: they stay). A document none of whose lines go keeps
    its text as it is; one all of whose lines go keeps an empty text. Null text: stays null, with no lines. Null
    doc_id: last in order. Repeated rows (same doc_id, same text) are one document: all are cut alike, and the first
    occurrence of a line stays in each. Empty table: no rows. Very long texts and lines are taken whole. Other columns
    pass, whatever their names; only own columns ``__lines`` and ``__kept`` are replaced.
    """
    drop = duplicates(docs, least_chars=least_chars, exact_chars=exact_chars, hot=hot)
    doc, tie = _document()
    # the row's own columns travel in one, so no name of theirs can meet one of these
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc, tie).join(drop, ["doc", "tie"], "left")
    # numbers of kept lines by hash, not by a search per line; split serves twice, so it isn't evaluated per line
    rows = rows.withColumn("split", F.split("row.text", "\n"))
    n, gone = F.coalesce(F.size("split"), F.lit(0)), F.coalesce(F.size("drop"), F.lit(0))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "drop"), lambda i: F.get("split", i))
    out = rows.select("row", n.cast("long").alias("__lines"), (n - gone).cast("long").alias("__kept"), F.when(gone > 0, F.array_join(kept, "\n")).otherwise(F.col("row.text")).alias("text"))
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("__lines", "__kept")]
    return out.select(*own, "__lines", "__kept")
