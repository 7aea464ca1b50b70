"""License scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batch, map_batches, words_of
from .license_texts import TEXTS


@dataclass(frozen=True)
class Template:
    """A text whose words (in their order, few missing) show a license; keys: phrases that must stand in it."""

    label: str
    text: str
    keys: tuple[str, ...] = ()


#: A place of these counts wherever the words stand consecutively.
PHRASES = (Template("mit", "under the mit license"), Template("apache-2", "apache license version 2"), Template("cc-by-nc", "cc by nc"))
#: Wider wordings: a place needs most of the words in their order, and each key phrase whole.
TEMPLATES = tuple(Template(*t) for t in TEXTS)

#: Words of a template that are looked up for a file, the share of its words that must stand in order in a place, and
#: how far one place's words may be shifted against each other: one word, and one more for each SHIFT words.
RARE, SHARE, SHIFT = 6, 0.8, 8


def in_order(words: list[bytes], places: dict[bytes, int]) -> int:
    """The longest common subsequence of a template (as its words' places, one bit each) and ``words``; bit-parallel."""
    row = 0
    for w in words:
        m = places.get(w, 0)
        x = row | m
        row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


class Index:
    """Postings (template, position) of the templates' words, for the positional look-up."""

    def __init__(self, phrases: tuple[Template, ...], templates: tuple[Template, ...], idf: dict[bytes, float]) -> None:
        self.items = [*phrases, *templates]
        self.n_phrases = len(phrases)
        self.words = [words_of(t.text) for t in self.items]
        self.keys = [[words_of(k) for k in t.keys] for t in self.items]
        rank = lambda w: (-idf.get(w, 0.0), w)
        self.postings: list[dict[bytes, list[int]]] = []
        self.places: list[dict[bytes, int]] = []
        for words in self.words:
            at: dict[bytes, list[int]] = {}
            for q, w in enumerate(words):
                at.setdefault(w, []).append(q)
            self.postings.append({w: at[w] for w in sorted(at, key=rank)})  # in descending idf
            self.places.append({w: sum(1 << q for q in qs) for w, qs in at.items()})
        self.shift = [1 + len(w) // SHIFT if i >= self.n_phrases else 0 for i, w in enumerate(self.words)]
        self.vocabulary = frozenset(w for words in self.words for w in words)

    def _anchors(self, i: int, present: set[bytes]) -> list[bytes]:
        """The template's words of highest idf that the file has: RARE of them (a phrase: one); none if it lacks too many."""
        n, have, out = len(self.words[i]), 0, []
        most = 1 if i < self.n_phrases else RARE
        for w, at in self.postings[i].items():
            if w in present:
                have += len(at)
                if len(out) < most:
                    out.append(w)
        return out if have >= (n if i < self.n_phrases else SHARE * n - 1e-9) else []

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, float]]]:
        """Places of phrases (item, start), all of them; places of templates (item, start, share of words in order).

        For each template the file's own rarest words of it are looked up. Each occurrence votes for where the template
        would start; votes meet if they lie within the template's shift of each other, so words may be missing or put
        in. A place with votes from half of the looked-up words is aligned word by word.
        """
        present = self.vocabulary.intersection(words)
        anchors = [self._anchors(i, present) for i in range(len(self.items))] if present else []
        wanted = {w for a in anchors for w in a}
        if not wanted:
            return [], []
        seen: dict[bytes, list[int]] = {w: [] for w in wanted}
        for p, w in enumerate(words):
            if w in wanted:
                seen[w].append(p)
        base, own = [], []
        for i, looked_up in enumerate(anchors):
            if not looked_up:
                continue
            if i < self.n_phrases:
                t, (w,) = self.words[i], looked_up
                starts = {p - q for p in seen[w] for q in self.postings[i][w] if p >= q}
                base += [(i, s) for s in starts if words[s : s + len(t)] == t]
            else:
                own += self._places(i, words, looked_up, sorted((p - q, k) for k, w in enumerate(looked_up) for p in seen[w] for q in self.postings[i][w]))
        return sorted(set(base)), sorted(own)

    def _places(self, i: int, words: list[bytes], looked_up: list[bytes], votes: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
        n, shift, out = len(self.words[i]), self.shift[i], []
        counts: Counter[int] = Counter()
        left, after = 0, -n
        for s, k in votes:  # a window over the sorted votes: all within ``shift`` of its first
            counts[k] += 1
            while votes[left][0] < s - shift:
                gone = votes[left][1]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
                left += 1
            if 2 * len(counts) < len(looked_up) or s < after:
                continue
            start = max(0, votes[left][0] - shift)
            part = words[start : s + n + shift]
            share = in_order(part, self.places[i]) / n
            if share >= SHARE - 1e-9 and all(any(part[j : j + len(key)] == key for j in range(len(part) - len(key) + 1)) for key in self.keys[i]):
                first = next(j for j in range(len(part)) if part[j] in self.places[i])
                out.append((i, start + first, share))
                after = s + n // 2  # the same place isn't found again
        return out


def word_idf(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """Inverse document frequency of these (few) words over all texts; each task sends one count per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                counts.update(vocabulary.intersection(words_of(text)))
        words = [*counts]
        yield pa.RecordBatch.from_arrays([pa.array(words + [None], pa.binary()), pa.array([counts[w] for w in words] + [n], pa.int64())], names=["word", "n"])

    seen = {r.word if r.word is None else bytes(r.word): r.n for r in map_batches(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = seen.get(None) or 0
    return {w: math.log((1 + total) / (1 + seen.get(w, 0))) for w in vocabulary}


OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,share:double>>"
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", _SPANS)])


def scan(docs: DataFrame, phrases: tuple[Template, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """License phrases and templates in ``docs(doc_id, text)``; one row per input row.

    Two passes without a shuffle of texts: inverse document frequencies of the templates' words over all documents,
    then the scan. Null or empty text: no words, no labels, score 0. Null doc_id and repeated rows are kept. Empty
    table: no rows. Other columns are ignored. Texts of any length are read whole. score: the largest share of a found
    template's words that stand in order in one place; 1 for a phrase.
    """
    vocabulary = frozenset(w for t in (*phrases, *templates) for w in words_of(t.text))
    index = Index(phrases, templates, word_idf(docs, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {n: [] for n in _OUT.names}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(text)
                base, own = index.find(words)
                starts = [s for _, s in base]
                labels = {index.items[i].label for i, _ in base}
                spans = [(index.items[i].label, s, 1.0) for i, s in base] + [(index.items[i].label, s, share) for i, s, share in own]
                row = (doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in spans})), max((x[2] for x in spans), default=0.0), [{"label": a, "start": s, "share": h} for a, s, h in spans])
                for c, v in zip(columns.values(), row):
                    c.append(v)
            yield batch(_OUT, columns)

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, OUT)
