"""Words of whole texts as 64-bit numbers, by the batch and through a bounded cache."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import xxhash

#: Texts are taken in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
MOST_CACHED = 200_000
LONGEST_CACHED = 64

ODD_1, ODD_2, ODD_3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class WordNumbers(dict):
    """word (bytes) -> unsigned 64-bit number; forgets everything when too many words are held."""

    def __init__(self, make: Callable[[bytes], int] = xxhash.xxh64_intdigest):
        super().__init__()
        self.make = make

    def __missing__(self, word: bytes) -> int:
        value = self.make(word)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= MOST_CACHED:
                self.clear()
            self[word] = value
        return value

    def of(self, texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all words of ``texts`` one after another, and the number of words of each text.

        Words are what ASCII white space separates; ``lower`` turns A-Z to lower case.
        """
        words = [t.lower().split() for t in texts] if lower else [t.split() for t in texts]
        counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(counts.sum()))
        return numbers, counts


_KEPT: dict = {}


def kept(name, make):
    """What a Python worker keeps between tasks under one name; asking for another name drops it.

    Workers outlive the stages they serve, so that what one stage remembered would otherwise
    lie beside what the next one does.
    """
    if _KEPT.get("name") != name:
        _KEPT.clear()
        _trim()
        _KEPT.update(name=name, value=make())
    return _KEPT["value"]


def _trim() -> None:
    """Give freed memory back to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * ODD_2
    x = (x ^ (x >> np.uint64(27))) * ODD_3
    return x ^ (x >> np.uint64(31))


def slices(texts: Iterable[bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of slices of bounded size; no text counts as an empty one."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t or b"")
        size += len(held[-1])
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def windows(numbers: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One number for each run of ``width`` words inside a text, and the text's index.

    A text of fewer words has its whole sequence as one run; one without words has none.
    """
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(numbers)) - np.repeat(ends - counts, counts)
    left = np.repeat(counts, counts) - at
    rolled = np.zeros(len(numbers), dtype=np.uint64)
    for k in range(min(width, len(numbers))):  # a slice may hold fewer words than one run
        rolled[: len(numbers) - k] = (rolled[: len(numbers) - k] + np.uint64(k + 1)) * ODD_1 + numbers[k:] if k else numbers
    whole = left >= width
    out, text = mixed(rolled[whole]), owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        starts = (ends - counts)[short]
        for k in range(width - 1):
            inside = counts[short] > k
            extra[inside] = (extra[inside] + np.uint64(k + 1)) * ODD_1 + numbers[starts[inside] + k] if k else numbers[starts[inside]]
        out = np.concatenate([out, mixed(extra + counts[short].astype(np.uint64) * ODD_2)])
        text = np.concatenate([text, short])
    return out, text


def distinct(numbers: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by owner, then number; each pair once."""
    order = np.lexsort((numbers, owner))
    numbers, owner = numbers[order], owner[order]
    new = np.ones(len(numbers), dtype=bool)
    new[1:] = (numbers[1:] != numbers[:-1]) | (owner[1:] != owner[:-1])
    return numbers[new], owner[new]
