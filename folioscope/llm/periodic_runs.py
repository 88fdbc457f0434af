"""Periodic runs of words by online dyadic square catching.

Words are appended one after the other. Each completed block of 2 ** k words, at a multiple of 2 ** k, gets a catcher that
looks out for squares whose first half holds the block: halves of 2 * 2 ** k - 1 to 4 * 2 ** k - 2 words, so that some block size
serves every half. An appended word completes one suffix of each size, which two catchers of that size have in view; a
suffix that equals a catcher's block is a hit, at the distance of a possible period. Hits of neighbouring blocks at one
distance join into squares, squares into runs; a run's ends are found word by word, less than a block away.

Appending is done for many words at once, as array operations: a batch's documents are one stream, parted by marks that
equal nothing. Suffixes are compared by 64-bit names made from the names of their halves; a run is only reported
once its words themselves have been compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bytes_of, id_and_text
from folioscope.llm.word_stream import Numbered, joined

#: A run has at least so many words and repeats its period at least so many times.
LEAST, TIMES = 24, 3
#: Documents of one stream have about so many words together; a longer document is a stream of its own.
STREAM_WORDS = 1 << 18
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def name_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of blocks from those of their halves."""
    h = left * _A + right * _B
    h ^= h >> np.uint64(29)
    h *= _B
    h ^= h >> np.uint64(32)
    return h


class Catchers:
    """Runs in a stream of numbers that is appended piece by piece. `longest`: no run is longer than this."""

    def __init__(self, longest: int, least: int = LEAST, times: int = TIMES):
        self.least, self.times = least, times
        self.parts: list[np.ndarray] = []
        self.n = 0
        self.sizes = [1]
        while times * (4 * self.sizes[-1] - 1) <= longest:
            self.sizes.append(2 * self.sizes[-1])
        self.names = [np.zeros(0, np.uint64) for _ in self.sizes]  # of each size, those still in view
        self.first = [0 for _ in self.sizes]  # where the first of them begins
        self.hits: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.sizes]

    def append(self, ids: np.ndarray) -> None:
        """All appended words advance the comparisons of all catchers that have them in view."""
        self.parts.append(ids)
        self.n += len(ids)
        new = ids.astype(np.uint64)
        for k, b in enumerate(self.sizes):
            begin = self.first[k] + len(self.names[k])
            if k:
                half, low = self.sizes[k - 1], begin - self.first[k - 1]
                below = self.names[k - 1][low:]
                if len(below) <= half:
                    break  # no suffix of this size is complete
                new = name_of(below[: len(below) - half], below[half:])
            names = self.names[k] = np.concatenate([self.names[k], new])
            x = np.arange(begin, begin + len(new))
            # the two blocks that may be left halves' blocks for a suffix at x
            nearest = (x - (2 * b - 1)) // b * b
            for s in (nearest, nearest - b):
                at = s - self.first[k]
                hit = np.flatnonzero((s >= 0) & (names[np.maximum(at, 0)] == new))
                if len(hit):
                    self.hits[k].append((s[hit], x[hit] - s[hit]))
        for k, b in enumerate(self.sizes):  # what no later suffix can reach goes
            out = len(self.names[k]) - 4 * b
            if out > 0:
                self.names[k], self.first[k] = self.names[k][out:], self.first[k] + out

    def runs(self) -> list[tuple[int, int, int]]:
        """start, length, period of all runs so far, sorted."""
        t = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64)
        found: dict[tuple[int, int], int] = {}
        for k, b in enumerate(self.sizes):
            if not self.hits[k]:
                continue
            s, p = (np.concatenate(x) for x in zip(*self.hits[k]))
            order = np.lexsort((s, p))
            s, p = s[order], p[order]
            cut = np.flatnonzero((np.diff(p) != 0) | (np.diff(s) != b)) + 1
            left, right, q = s[np.r_[0, cut]], s[np.r_[cut, len(s)] - 1] + b, p[np.r_[0, cut]]
            keep = right - left + 2 * (b - 1) >= np.maximum(self.least - q, (self.times - 1) * q)
            if found:  # inside a run of a smaller period there are only multiples of that
                known = np.array(sorted(found))
                at = np.searchsorted(known[:, 0], left, "right") - 1
                keep &= (at < 0) | (np.maximum.accumulate(known[:, 1])[np.maximum(at, 0)] < right + q)
            for lo, hi, d in zip(left[keep].tolist(), right[keep].tolist(), q[keep].tolist()):
                lo, hi = max(0, lo - b), min(self.n - d, hi + b)
                same = np.r_[False, t[lo:hi] == t[lo + d : hi + d], False]
                edge = np.flatnonzero(same[1:] != same[:-1])
                for x, y in zip(edge[::2].tolist(), edge[1::2].tolist()):
                    if y - x >= max(self.least - d, (self.times - 1) * d):
                        found.setdefault((lo + x, lo + y + d), d)
        return sorted((a, e - a, d) for (a, e), d in found.items())


def runs_of(sides: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several documents' numbered words."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in sides]
    order = [i for i in range(len(sides)) if len(sides[i]) >= LEAST]
    if not order:
        return out
    catchers, starts, at = Catchers(max(len(sides[i]) for i in order)), [], 0
    for k, i in enumerate(order):
        starts.append(at)
        at += len(sides[i]) + 1
    catchers.append(np.concatenate([x for k, i in enumerate(order) for x in (sides[i], [-1 - k])]))
    begins = np.array(starts)
    for a, n, d in catchers.runs():
        k = int(np.searchsorted(begins, a, "right")) - 1
        out[order[k]].append((a - starts[k], n, d))
    return out


def repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Flags of words that lie in a run behind its first period."""
    step = np.zeros(n + 1, np.int64)
    for a, length, d in runs:
        step[a + d] += 1
        step[a + length] -= 1
    return np.cumsum(step[:n]) > 0


def find_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, runs (array of start, length, period, sorted), collapsed (the text's words
    without a run's repeats, one space between).

    A null or empty text has no words and no runs; a null doc_id stays null; repeated rows are judged each for itself; runs
    with equal starts are in order of their period; an empty table gives an empty result; other columns are not read. Texts are
    read whole, whatever their length, in a stream of their own where they are long. One pass without a shuffle.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def rows(ids: list, data: list[bytes]) -> pa.RecordBatch:
        numbers = Numbered()
        sides = [numbers.ids(x) for x in data]
        # documents of like length share a stream, so that few blocks are made that no document has room for
        found: list = [None] * len(sides)
        for group in of_like_length([len(x) for x in sides]):
            for i, r in zip(group, runs_of([sides[i] for i in group])):
                found[i] = r
        collapsed = [joined(x, ~repeats(len(s), r)) for x, s, r in zip(data, sides, found)]
        values = [[{"start": a, "length": n, "period": d} for a, n, d in r] for r in found]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sides], pa.int64()), pa.array(values, run_type), pa.array(collapsed, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data, size = [], [], 0
            for doc, x in zip(batch.column(0).to_pylist(), bytes_of(batch)):
                x = x or b""
                if ids and size + len(x) > 8 * STREAM_WORDS:
                    yield rows(ids, data)
                    ids, data, size = [], [], 0
                ids.append(doc)
                data.append(x)
                size += len(x)
            if ids:
                yield rows(ids, data)

    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def of_like_length(sizes: list[int]) -> list[list[int]]:
    """Places of sizes, in groups by their power of two."""
    groups: dict[int, list[int]] = {}
    for i, n in enumerate(sizes):
        groups.setdefault(n.bit_length(), []).append(i)
    return list(groups.values())
