"""Words of texts as numbers, a slice of a text at a time."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import xxhash

#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def slices(data: bytes) -> Iterator[bytes]:
    """data in slices that end at white space, so that no word is cut; bytes.split() parts at just the same bytes."""
    at = 0
    while len(data) - at > SLICE:
        m = _SPACE.search(data, at + SLICE)
        stop = m.end() if m else len(data)
        yield data[at:stop]
        at = stop
    yield data[at:]


class Numbered(defaultdict):
    """Consecutive numbers of words, in the order in which they come: equal numbers, equal words."""

    def __init__(self):
        super().__init__(count().__next__)

    def ids(self, data: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, x.split()), np.int64) for x in slices(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


class Hashed(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    MOST, LONG = 1 << 18, 256

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = value
        return value

    def hashes(self, data: bytes) -> np.ndarray:
        parts = [np.fromiter(map(self.__getitem__, x.split()), np.uint64) for x in slices(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def joined(data: bytes, keep: np.ndarray) -> str:
    """The words whose flag is set, one space between them."""
    out, at = [], 0
    for x in slices(data):
        words = x.split()
        flags = keep[at : at + len(words)]
        at += len(words)
        out += words if flags.all() else [words[i] for i in np.flatnonzero(flags).tolist()]
    return b" ".join(out).decode("utf-8", "replace")
