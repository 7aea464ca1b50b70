"""Edit-aware token counts: a stored segment tree of pre-tokens per document."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batch, map_batches, materialize
from .tokens import ChunkEncoder

#: A leaf is a run of pre-tokens of about this many characters.
LEAF_CHARS = 64
_SPACE = re.compile(r"[ \n]")
_SIGN = "!-&(-/:;=?@\\[-`{}~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
_ALNUM = "0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u3041-\u3094\u30a1-\u30f4\u4e00-\u9fa5\uac00-\ud7a3"
#: Where pre-tokens end without white space, whatever follows later: a sign (no apostrophe, and none of special tokens)
#: before a letter or digit or the other way round, and either side of a digit. Only characters that compose with
#: nothing across the place, and that all Unicode versions class alike.
_EDGE = re.compile(f"(?<=[{_SIGN}])(?=[{_ALNUM}])|(?<=[0-9A-Za-z])(?=[{_SIGN}])|(?<=[0-9])(?=[0-9A-Za-z])|(?<=[A-Za-z])(?=[0-9])")


def leaves(text: str) -> list[str]:
    """The text in pieces of LEAF_CHARS characters or more that end where pre-tokens end.

    At the first space or line feed (it begins the next piece); if none comes within as many characters again, at the
    first other end of a pre-token. No token reaches across either, so a text's tokens are its leaves' tokens. One
    pre-token however long is one piece: the vocabulary's merges take it as a whole.
    """
    out, at, size = [], 0, len(text)
    while at < size:
        m = _SPACE.search(text, at + LEAF_CHARS, at + 2 * LEAF_CHARS) or _EDGE.search(text, at + LEAF_CHARS, min(size, at + 2 * LEAF_CHARS)) or _either(text, at + 2 * LEAF_CHARS)
        end = m.start() if m and m.start() < size else size
        out.append(text[at:end])
        at = end
    return out


def _either(text: str, at: int):
    """The first space or edge from ``at`` on, looked for in growing windows."""
    step = 4 * LEAF_CHARS
    while at < len(text):
        found = [m for m in (_SPACE.search(text, at, at + step), _EDGE.search(text, at, min(len(text), at + step))) if m]
        if found:
            return min(found, key=lambda m: m.start())
        at += step
        step *= 2
    return None


class Tree:
    """A treap-shaped sequence of leaves; each node holds the characters and tokens below it.

    Places are found and sums mended along one path, so an edit costs the leaves that it touches and a logarithm of
    the rest. Priorities come from a fixed generator: equal edits give equal trees. ``stored``, the leaves' lengths and
    tokens from an earlier tree, spares the encoding; without it all leaves are encoded.
    """

    __slots__ = ("count", "encoded", "root", "_next")

    def __init__(self, count: Callable[[list[str]], list[int]], text: str | None, stored: tuple[list[int], list[int]] | None = None) -> None:
        self.count, self.encoded, self._next = count, 0, 0x2545F491
        if stored is None:
            pieces = leaves(text or "")
            self.root = self._build(list(zip(pieces, self._counts(pieces))))
        else:
            items, at = [], 0
            for size, n in zip(*stored):
                items.append((text[at : at + size], n))
                at += size
            if at != len(text or ""):
                raise ValueError("these leaves are of another text")
            self.root = self._build(items)

    def _counts(self, pieces: list[str]) -> list[int]:
        self.encoded += len(pieces)
        return self.count(pieces)

    def _priority(self) -> int:
        x = self._next
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        self._next = x
        return x

    # a node: [left, right, priority, text, tokens, characters below, tokens below, leaves below]
    def _build(self, items: list[tuple[str, int]]):
        if not items:
            return None
        nodes = [None] * len(items)
        spine: list[list] = []
        for k, (text, n) in enumerate(items):
            node = nodes[k] = [None, None, self._priority(), text, n, 0, 0, 0]
            last = None
            while spine and spine[-1][2] < node[2]:
                last = spine.pop()
                self._sum(last)
            node[0] = last
            if spine:
                spine[-1][1] = node
            spine.append(node)
        for node in reversed(spine):
            self._sum(node)
        return spine[0]

    @staticmethod
    def _sum(node) -> None:
        left, right = node[0], node[1]
        node[5] = len(node[3]) + (left[5] if left else 0) + (right[5] if right else 0)
        node[6] = node[4] + (left[6] if left else 0) + (right[6] if right else 0)
        node[7] = 1 + (left[7] if left else 0) + (right[7] if right else 0)

    def _split(self, node, k: int):
        """The first k leaves, and the rest."""
        if node is None:
            return None, None
        before = node[0][7] if node[0] else 0
        if k <= before:
            a, node[0] = self._split(node[0], k)
            self._sum(node)
            return a, node
        node[1], b = self._split(node[1], k - before - 1)
        self._sum(node)
        return node, b

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[2] > b[2]:
            a[1] = self._join(a[1], b)
            self._sum(a)
            return a
        b[0] = self._join(a, b[0])
        self._sum(b)
        return b

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """(number of the leaf that holds character ``at``, its start); the end of the text belongs to the last leaf."""
        node, k, start = self.root, 0, 0
        while node:
            left, own = (node[0][5] if node[0] else 0), len(node[3])
            if at < start + left and node[0]:
                node = node[0]
            elif at < start + left + own or node[1] is None:
                return k + (node[0][7] if node[0] else 0), start + left
            else:
                k += (node[0][7] if node[0] else 0) + 1
                start += left + own
                node = node[1]
        return 0, 0

    def _texts(self, node) -> list[str]:
        out, stack = [], []
        while node or stack:
            while node:
                stack.append(node)
                node = node[0]
            node = stack.pop()
            out.append(node[3])
            node = node[1]
        return out

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Delete ``delete`` characters at ``at`` and put ``insert`` there; beyond the end counts as the end."""
        size = self.characters
        at = max(0, min(at, size))
        end = max(at, min(size, at + delete))
        # the boundary's context: the leaf before the edit, as its last token may grow, and the one at its end
        first, start = self._leaf_at(max(0, at - 1))
        last, _ = self._leaf_at(end)
        a, rest = self._split(self.root, first)
        middle, b = self._split(rest, last - first + 1)
        old = "".join(self._texts(middle))
        pieces = leaves(old[: at - start] + insert + old[end - start :])
        self.root = self._join(self._join(a, self._build(list(zip(pieces, self._counts(pieces))))), b)

    @property
    def characters(self) -> int:
        return self.root[5] if self.root else 0

    @property
    def tokens(self) -> int:
        return self.root[6] if self.root else 0

    @property
    def n_leaves(self) -> int:
        return self.root[7] if self.root else 0

    def text(self) -> str:
        return "".join(self._texts(self.root))

    def stored(self) -> tuple[list[int], list[int]]:
        """The leaves' lengths and tokens, for a later tree."""
        sizes, tokens, stack, node = [], [], [], self.root
        while node or stack:
            while node:
                stack.append(node)
                node = node[0]
            node = stack.pop()
            sizes.append(len(node[3]))
            tokens.append(node[4])
            node = node[1]
        return sizes, tokens


EDITS = "array<struct<at:long,delete:long,insert:string>>"


TREE = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>, n_tokens long"
_TREE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("leaf_chars", pa.list_(pa.int32())), ("leaf_tokens", pa.list_(pa.int32())), ("n_tokens", pa.int64())])


def _counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    encoder = ChunkEncoder.shared(vocabulary)
    return lambda pieces: [len(b) // 4 for b in encoder.encode(pieces)]


def trees(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The segment trees of ``docs(doc_id, text)``, to be stored: each text with its leaves' lengths and tokens.

    Inner sums are made again from the leaves when a tree is edited, without encoding anything. Null text: kept null,
    with no leaves. Null doc_id and repeated rows are kept, each with its own tree. Empty table: no rows. Other columns
    are ignored. Texts of any length are encoded whole. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        for b in batches:
            texts = b.column(1).to_pylist()
            pieces = [leaves(t or "") for t in texts]
            tokens = [count(p) for p in pieces]
            yield batch(_TREE, {"doc_id": b.column(0), "text": b.column(1), "leaf_chars": [list(map(len, p)) for p in pieces], "leaf_tokens": tokens, "n_tokens": list(map(sum, tokens))})

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, TREE)


def attach_edits(table: DataFrame, edits: DataFrame) -> DataFrame:
    """``table`` (documents or trees) with a column ``edits``: those of ``edits(doc_id, seq, at, delete, insert)`` in the order of seq.

    One document's edits depend on each other, so they are one group; documents are spread by doc_id. Edits of
    unknown or null doc_ids are dropped; a null ``at`` or ``delete`` is 0, a null ``insert`` empty. An own column
    ``edits`` is replaced.
    """
    one = F.struct("seq", F.coalesce(F.col("at").cast("long"), F.lit(0)).alias("at"), F.coalesce(F.col("delete").cast("long"), F.lit(0)).alias("delete"), F.coalesce("insert", F.lit("")).alias("insert"))
    made = F.transform(F.array_sort(F.collect_list(one)), lambda e: F.struct(e.at.alias("at"), e.delete.alias("delete"), e.insert.alias("insert")))
    by = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc")).agg(made.alias("edits")).alias("e")
    rows = table.drop("edits").withColumn("doc_id", F.col("doc_id").cast("long")).alias("t")
    return rows.join(by, F.col("t.doc_id") == F.col("e.doc"), "left").select("t.*", "e.edits")


_COUNTS = ("doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_leaves", "leaves_encoded", "n_chars", "text_crc32")
_DIGEST = pa.schema([(n, pa.int64()) for n in _COUNTS])
_EDITED = pa.schema([*_DIGEST, *(f for f in _TREE if f.name in ("text", "leaf_chars", "leaf_tokens"))])
DIGEST = ", ".join(f"{n} long" for n in _COUNTS)
EDITED = DIGEST + ", text string, leaf_chars array<int>, leaf_tokens array<int>"


def edit(trees: DataFrame, vocabulary: str, *, digest: bool = False) -> DataFrame:
    """Apply the edits of ``trees(doc_id, text, leaf_chars, leaf_tokens, edits)`` in order: the new trees and their counts.

    Only leaves that an edit touches, and the one before, are encoded (``leaves_encoded`` of ``n_leaves``, the leaves
    there were). The result holds what ``trees`` holds, so it can be stored and edited again; ``digest`` leaves texts and
    leaves out. Null or empty ``edits``: none; places beyond the text count as its end, negative ones as 0. Null text:
    empty. Null doc_id and repeated rows are kept. Empty table: no rows. Other columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(vocabulary)
        schema = _DIGEST if digest else _EDITED
        for b in batches:
            rows = []
            for doc, text, sizes, tokens, edits in zip(*(c.to_pylist() for c in b.columns)):
                tree = Tree(count, text or "", (sizes or [], tokens or []))
                before, n = tree.tokens, tree.n_leaves
                for e in edits or ():
                    tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                after = tree.text()
                row = (doc, before, tree.tokens, len(edits or ()), n, tree.encoded, tree.characters, zlib.crc32(after.encode("utf-8", "surrogatepass")))
                rows.append(row if digest else (*row, after, *tree.stored()))
            if rows:
                yield batch(schema, dict(zip(schema.names, map(list, zip(*rows)))))

    return map_batches(trees.select(F.col("doc_id").cast("long"), "text", "leaf_chars", "leaf_tokens", F.col("edits").cast(EDITS)), run, DIGEST if digest else EDITED)


def counts(docs: DataFrame, vocabulary: str, edits: DataFrame) -> DataFrame:
    """Token counts of ``docs(doc_id, text)`` before and after ``edits`` (see ``attach_edits``), by a stored table of trees."""
    return edit(attach_edits(materialize(trees(docs, vocabulary), "trees"), edits), vocabulary, digest=True)
