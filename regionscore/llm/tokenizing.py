"""Whole texts to token ids, word by word through a bounded cache in each Python worker.

Both tokenizers split a text before they merge bytes, and no merge crosses a split. For
texts of the characters in ``PLAIN`` the places of the splits are known from white space
alone, so each distinct word is encoded once and looked up afterwards. Any other text
(other scripts, rare white space, special-token strings) goes to the library as a whole.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np

#: Letters, digits, marks and white space for which the split rules below are checked in tests.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ž"
NOT_PLAIN = re.compile(f"[^\t\n\r -~{LETTERS}¡¿«»–—‘’“”…€]|<\\|")
#: White space whose split depends on what follows: runs, and tabs or returns.
ODD_SPACE = re.compile(r"[\t\r]|[ \n]{2}")
#: Words longer than this are encoded but not remembered.
LONGEST_CACHED = 64
MOST_CACHED = 400_000


def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else the next free one."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(free)) for b in range(256)]


class _Remembering(dict):
    """word -> value, made on a miss. When the table is full it becomes the one before, from which words met again are taken."""

    def __init__(self, make, most: int = MOST_CACHED):
        super().__init__()
        self.make, self.half = make, most // 2
        self.before: dict = {}

    def __missing__(self, word: str):
        value = self.before.get(word)
        if value is None:
            value = self.make(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= self.half:
                self.before = dict(self)
                self.clear()
            self[word] = value
        return value


class _Tiers(dict):
    """A fixed table, and behind it a table of bounded size for what is not in it."""

    def __init__(self, fixed: dict, rest: _Remembering):
        super().__init__(fixed)
        self.rest = rest

    def __missing__(self, word: str):
        return self.rest[word]


class WordIds:
    """Ids (little-endian unsigned 32 bit) of a text under the lower-casing word tokenizer."""

    PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.model = self.library.model
        # words with marks at their ends share the ids of the bare word
        self.pieces = _Remembering(self._piece, MOST_CACHED * 3 // 4)
        self.words = _Remembering(lambda word: b"".join(map(self.pieces.__getitem__, self.PIECES.findall(word))))

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # visible ASCII stands for itself
            letters = _byte_letters()
            piece = "".join([letters[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if NOT_PLAIN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.lower().split()))


class PieceLengths:
    """Number of ids of a text under the byte-level tokenizer: two tiers of word lengths, then the library.

    ``frequent`` is the table every worker gets; a word not in it is encoded once and kept in the
    worker's own cache.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        self.library = tokenizer(path)
        self.lengths = _Tiers(frequent, _Remembering(lambda piece: len(self.library.encode(piece, add_special_tokens=False).ids)))

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        pieces = split_pieces(text)
        if pieces is None:
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.lengths.__getitem__, pieces))


def split_pieces(text: str) -> list[str] | None:
    """Parts of a text between which no merge happens, or None where that takes the library's own rules."""
    if NOT_PLAIN.search(text) or ODD_SPACE.search(text):
        return None
    pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    return [p for p in pieces if p] if "" in pieces else pieces
