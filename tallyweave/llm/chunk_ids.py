"""Token ids of whole texts through a cache of their chunks.

A byte-level tokenizer cuts a text by its pattern before it looks at the vocabulary, and a single
white-space character with other characters on both sides always begins a new piece. So a text
may be cut there and its chunks encoded apart. Words recur, so most chunks are known already.
Plain Latin words go to the tokenizer's model at once, which skips its cutting; that both give the
same is tried out. With any other tokenizer, and if a text holds an added token, the whole text is
encoded at once.
"""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache

import numpy as np

CACHED_CHUNKS = 1_200_000

_CUT = re.compile(r"(?<=\S)(?=\s\S)")
_PLAIN = re.compile(r"(\n?)([A-Za-zÀ-ÖØ-öø-ɏ]+)([.,;:!?]?)")
_PROBE = "Onze words, d'été\nñandú  x1.\t\nABC's  12　a b\n c \n\nd 3.5 e\t"
_PLAIN_PROBE = ["Onze", "words,", "été", "\nÑandú", "\nx!", "z", "ſ?", "Retion."]
# how byte-level tokenizers write bytes: printable letters stand for themselves
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _KEPT]
_LETTERS = "".join(chr(256 + _OTHERS.index(b) if b in _OTHERS else b) for b in range(256))


class _Open(Exception):
    """A chunk with white space at an end: the text has to be cut with care."""


class ChunkIds(dict):
    """Ids of chunks after a space, as little-endian unsigned 32-bit bytes; see :func:`chunk_ids`.

    A chunk that begins with a line feed stands for itself, any other for a space and itself.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.literal: dict[str, bytes] = {}
        self.marks = dict(zip(["", *".,;:!?\n"], self._encode(["", *".,;:!?\n"])))
        bytewise = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.by_chunks = bytewise and self._encode([_PROBE])[0] == b"".join(self._encode(_CUT.split(_PROBE)))
        given = self._encode([c if c[0] == "\n" else " " + c for c in _PLAIN_PROBE])
        self.direct = self.by_chunks and all(self._plain(_PLAIN.fullmatch(c)) == ids for c, ids in zip(_PLAIN_PROBE, given))

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype="<u4").tobytes() for f in found]

    def _word(self, piece: str) -> bytes:
        found = self.tokenize(charmap_decode(piece.encode("utf-8"), "strict", _LETTERS)[0])
        return array("I", [t.id for t in found]).tobytes()

    def _plain(self, parts: re.Match) -> bytes:
        feed, word, mark = parts.groups()
        if feed:
            return self.marks["\n"] + self._word(word) + self.marks[mark]
        stem = self.get(word)
        if stem is None:
            stem = self[word] = self._word(" " + word)
        return stem + self.marks[mark] if mark else stem

    def __missing__(self, chunk: str) -> bytes:
        if self.direct and chunk.isalpha() and (chunk.isascii() or max(chunk) <= "ɏ") and len(self) <= CACHED_CHUNKS:
            ids = self[chunk] = self._word(" " + chunk)
            return ids
        if not chunk.lstrip("\n") or chunk[-1].isspace() or chunk[chunk[0] == "\n"].isspace():
            raise _Open
        if len(self) > CACHED_CHUNKS:
            # the chunks seen first are the frequent ones: keep half of them
            for c in list(self)[CACHED_CHUNKS // 2 :]:
                del self[c]
        parts = _PLAIN.fullmatch(chunk) if self.direct else None
        ids = self._plain(parts) if parts else self._encode([chunk if chunk[0] == "\n" else " " + chunk])[0]
        self[chunk] = ids
        return ids

    def _of_literals(self, chunks: list[str]) -> bytes:
        missing = [c for c in set(chunks) if c not in self.literal]
        if len(self.literal) + len(missing) > CACHED_CHUNKS // 4:
            self.literal.clear()
            missing = list(set(chunks))
        self.literal.update(zip(missing, self._encode(missing)))
        return b"".join(map(self.literal.__getitem__, chunks))

    def of(self, text: str | None) -> bytes:
        """The ids of a text; a null text has none."""
        if not text:
            return b""
        if not self.by_chunks or any(a in text for a in self.added):
            return self._encode([text])[0]
        chunks = text.replace("\n", " \n").split(" ")
        try:
            if not chunks[0] or chunks[0][0].isspace() or chunks[0][-1].isspace():
                raise _Open
            return self._of_literals(chunks[:1]) + b"".join(map(self.__getitem__, chunks[1:]))
        except _Open:
            return self._of_literals(_CUT.split(text))


@lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    """The cache of this worker, kept from task to task."""
    return ChunkIds(path)
