"""Token ids by a public tokenizer, remembered per white-space-separated chunk."""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

from .base import remembered

VOCABULARY = "word_bpe_49k.json"
END_ID = 2


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: ASCII signs that a chunk may end in; not the apostrophe, which begins contractions.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lower-case Latin-1 words: normal forms of themselves, and one run of letters.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]{1,64}")
#: From U+0300 on there are marks that compose with what stands before them, and letters that Unicode versions disagree on.
_HIGH = re.compile("[^\x00-\u02ff]")
#: Latin-1 bytes by kind: letter or digit, comma or full stop, space; any other is "!", like the "?" of what isn't Latin-1.
_KINDS = bytes(ord("a" if b not in (0xAA, 0xB5, 0xBA) and (c.isalpha() or c in "0123456789") else "," if c in ",." else " " if c == " " else "!") for b, c in enumerate(map(chr, range(256))))
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level pre-tokenizers show bytes as characters: visible ones as themselves, the others from 256 on.
_STAND_INS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: Those of them that lower-case Latin-1 letters have in UTF-8.
_HIDDEN = [(chr(b), chr(_STAND_INS[b])) for b in (0x9F, 0xA0, 0xAD)]


def _shown(plain: str) -> str:
    """Plain words (and spaces between them) as byte-level models see them."""
    if not plain.isascii():
        plain = plain.encode().decode("latin-1")
        for byte, stand_in in _HIDDEN:
            plain = plain.replace(byte, stand_in)
    return plain


class _Chunks(dict):
    """Chunk -> its ids' bytes; learns a chunk when it is first asked for, and keeps it; long ones in ``long``, for one call."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.long: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if resize := getattr(self.model, "_resize_cache", None):
            resize(0)  # its own memory of words only costs time beside this one
        self.run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        # the short way holds for a model without dropout behind this vocabulary's pre-tokenizer; tried on a few words
        words = ["the", "a", "stra\u00dfe", "\u00e9t\u00e9\u00f1o\u00ff", "uncharacteristically"]
        self.by_model = all(self.tokenizer.encode(w, add_special_tokens=False).ids == [t.id for t in self.model.tokenize(_shown(w))] for w in words)

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64 and chunk in self.long:
            return self.long[chunk]
        if self.by_model and _PLAIN.fullmatch(chunk):
            # one pre-token that no normaliser changes: the model alone, on the bytes' stand-in characters
            ids = self[chunk] = array("I", [t.id for t in self.model.tokenize(_shown(chunk))]).tobytes()
            return ids
        base = chunk.rstrip(_SIGNS)
        if base and len(base) < len(chunk) and "<|" not in chunk and (e := base[-1]).isascii() and e.isalnum():
            ids = self[base] + self[chunk[len(base) :]]
        else:
            ids = array("I", self.run([chunk], add_special_tokens=False)[0].ids).tobytes()
        (self if len(chunk) <= 64 else self.long)[chunk] = ids
        return ids

    def shrink(self, most: int) -> None:
        """Keeps the chunks learnt first: common ones come early."""
        first = dict(islice(self.items(), 1 + most))
        self.clear()
        self.update(first)


class ChunkEncoder:
    """Encodes texts as the tokenizers library does, chunk by chunk.

    The vocabulary's normaliser and pre-tokenizer never look across white space and drop it, so a text's ids are
    those of its chunks, joined. Chunks are split at space and line feed only (other white space stays inside a
    chunk, for the library to handle). A chunk that ends in signs after an ASCII letter or digit is the chunk without
    them and then the signs, since a pre-token never holds both; where a comma or a full stop is the only sign, texts are
    split before it, so a word is learnt and kept once, not once with each. Ids are kept as little-endian unsigned 32-bit
    bytes: joining them is the encoding, and also what checksums are taken of. Chunks are remembered within a bound:
    after a text that takes them beyond ``most``, the half that was learnt first stays.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.most = most
        self.known = _Chunks(path)

    @classmethod
    def shared(cls, path: str) -> ChunkEncoder:
        """One encoder for this process: what a worker has learnt serves its later tasks, until it serves another operator."""
        return remembered(("chunks", path), lambda: cls(path))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none) as little-endian unsigned 32-bit bytes, without an end id."""
        out, known = [], self.known
        get = known.__getitem__
        for t in texts:
            t = t or ""
            # the vocabulary composes (NFC), then lower-cases. Below U+0300 nothing composes, so lower-casing may go
            # first; chunks beyond that go to the library as they are, and so do texts that may hold special tokens
            low = "<|" not in t
            high = low and not t.isascii() and _HIGH.search(t) is not None
            if low and not high:
                t = t.lower()
            t = t.replace("\n", " ")
            if low and not high and (", " in t or ". " in t):
                # a pre-token ends before a comma or full stop that follows a letter or digit, but not if it follows a sign
                kinds = t.encode("latin-1", "replace").translate(_KINDS)
                if not (b"!" in kinds and b"!, " in kinds) and b",, " not in kinds:
                    t = t.replace(", ", " , ").replace(". ", " . ")
            chunks = t.split(" ")
            if high:
                chunks = [c if _HIGH.search(c) else c.lower() for c in chunks]
            out.append(b"".join(map(get, chunks)))
            if len(known) > self.most:
                known.shrink(self.most // 2)
        known.long.clear()
        return out
