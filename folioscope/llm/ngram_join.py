"""Groups of documents whose word n-gram sets are similar (Jaccard), by a prefix-tree join. Exact.

1. Every document's n-grams are hashed and put in one global order: n-grams that many documents share last
   (those found are a list of fixed size; any order is right, a good one is fast), all others by hash.
   Documents with equal sets are one node from here on.
2. Two sets can only be similar if they share one of the first n-grams of each (their prefixes). N-grams with
   the same nodes in their prefixes form one block.
3. A node is compared with the block's smallest one: first with the nearest of all its blocks' smallest nodes, then
   with the others as far as they are not yet in one component. Blocks of one component are done.
4. In the other blocks the prefixes, written as runs of n-grams with the same nodes, are stored in a trie; a node's
   prefix walks it, nodes with a common continuation share the overlap found so far, and subtrees are left where the
   lengths that remain can't reach the overlap that is needed. Blocks of any size are cut into tiles, so that no task
   takes a whole one; pairs inside a component are left out, pairs inside a block's largest component not even tried.
5. The sets that still have partners are compared inside their tile. A tile keeps a union-find and hands on one link
   for each merge, fewer than it has nodes: a pair that is passed over is connected already.

Before any text is compared, a pair's parity sketches are: the bits in which they differ are no more than the n-grams
in which the sets differ, so a pair that this bound excludes is not similar. Every link that counts was found on whole sets.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import checkpointed, discard, fresh_name, tidy

WIDTH, NUM, DEN = 4, 85, 100
#: At most so many n-grams are ordered last; a batch reports those that LOCAL of its documents hold.
HEAVY, LOCAL, BATCH_HASHES = 131_072, 4, 2_000_000
#: Nodes and n-grams of a tile on each side, nodes compared with one copy of a probe.
TILE, TILE_GRAMS, FAN = 128, 1 << 20, 64
#: Blocks up to this size are looked through for possible partners before they are cut into tiles.
PEERS = 64
#: Runs of a path that a tile's row holds: behind the tile's block, and before it.
AHEAD, BEHIND = 64, 32
#: Bits an n-gram of the sketches in tiles.
ROUGH = 0.5
#: Bytes of text hashed at a time; ids above which no bitmap is made.
SLICE, MOST_MARKED = 1 << 20, 1 << 24
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])
#: A random number for each byte in lower case, and an odd base for its place.
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) | 1 for b in range(256)], np.uint64)[_LOWER]
_BASE = 0x9E6C63D0676A9A99


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _C[4]
    return h ^ (h >> np.uint64(29))


class Powers:
    """Powers of _BASE and of its inverse, modulo 2 ** 64, as far as needed."""

    def __init__(self):
        self.forth = self.back = np.ones(1, np.uint64)

    def up_to(self, n: int) -> None:
        while len(self.forth) < n:
            k = len(self.forth)
            self.forth = np.concatenate([self.forth, self.forth * np.uint64(pow(_BASE, k, 1 << 64))])
            self.back = np.concatenate([self.back, self.back * np.uint64(pow(_BASE, -k, 1 << 64))])


class Grams:
    """Sorted 63-bit hashes of each text's distinct n-grams; with fewer words, of the whole sequence."""

    def __init__(self, width: int):
        if not 1 <= width <= len(_C):
            raise ValueError(f"width must be 1 to {len(_C)}")
        self.width, self.powers = width, Powers()

    def words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts that begin at starts in data, and where each word begins."""
        n = len(data)
        solid = ~_SPACES[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        at = starts[(starts > 0) & (starts < n)]
        first[at] = solid[at]
        last[at - 1] = solid[at - 1]
        begin, end = np.flatnonzero(first), np.flatnonzero(last)
        self.powers.up_to(n)
        value = _BYTES[data] * self.powers.forth[:n]
        total = np.cumsum(value, dtype=np.uint64)
        return mixed((total[end] - total[begin] + value[begin]) * self.powers.back[begin]), begin

    def long_words(self, data: np.ndarray) -> np.ndarray:
        """Word hashes of one text of any length, a slice at a time, cut at spaces."""
        out, at = [], 0
        while at < len(data):
            stop = min(len(data), at + SLICE)
            while stop < len(data):
                spaces = np.flatnonzero(_SPACES[data[at:stop]])
                if len(spaces):
                    stop = at + int(spaces[-1]) + 1
                    break
                stop = min(len(data), 2 * stop - at)
            out.append(self.words(data[at:stop], np.zeros(1, np.int64))[0])
            at = stop
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def of_words(self, w: np.ndarray) -> np.ndarray:
        """Hashes of all n-grams of a row of words, whatever texts they stand in."""
        n, k = len(w), self.width
        if n < k:
            return np.zeros(0, np.uint64)
        h = w[: n - k + 1] * _C[0]
        for i in range(1, k):
            h = h + w[i : n - k + 1 + i] * _C[i]
        return mixed(h) >> np.uint64(1)

    def set_of(self, w: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The set of one text from its words and n-grams."""
        if not len(w):
            return np.zeros(0, np.uint64)
        if len(w) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b"\0" + w.tobytes()) >> 1], np.uint64)
        h = np.sort(h)
        return h[np.concatenate([[True], h[1:] != h[:-1]])]

    def __call__(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The sets of all texts of a column, in order; nulls have none."""
        column = texts.cast(pa.large_binary()).fill_null(b"")
        _, offsets, body = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        k = 0
        while k < len(column):
            end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
            part = data[offsets[k] : offsets[end]]
            if end == k + 1 and len(part) > SLICE:
                w = self.long_words(part)
                yield self.set_of(w, self.of_words(w))
            else:
                starts = offsets[k : end + 1] - offsets[k]
                w, begin = self.words(part, starts[:-1])
                h = self.of_words(w)
                bounds = np.searchsorted(begin, starts).tolist()
                for a, b in zip(bounds, bounds[1:]):
                    yield self.set_of(w[a:b], h[a : b - self.width + 1])
            k = end


def node_of(grams: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def key_of(doc_id: int | None, node: int) -> int:
    """Names one document's set: several texts may have one id, several documents one set."""
    return xxhash.xxh3_64_intdigest(f"{doc_id} {node}") - (1 << 63)


def sketch_of(grams: np.ndarray, bits_a_gram: float = 2) -> bytes:
    """For each value of the hashes' last bits, whether an odd number of n-grams has it; so many bits an n-gram at least, 256 in all."""
    bits = 1 << max(8, (int(bits_a_gram * len(grams)) - 1).bit_length())
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


class Sketch:
    """A sketch as a number, folded to fewer bits when it is compared with a shorter one."""

    __slots__ = ("folds",)

    def __init__(self, raw: bytes):
        self.folds = {8 * len(raw): int.from_bytes(raw, "big")}

    def of(self, bits: int) -> int:
        if bits not in self.folds:
            wide = self.of(2 * bits)
            self.folds[bits] = (wide >> bits) ^ (wide & ((1 << bits) - 1))
        return self.folds[bits]

    def apart(self, other: Sketch) -> int:
        """No more than the number of n-grams that one of the two sets has."""
        bits = min(max(self.folds), max(other.folds))
        return (self.of(bits) ^ other.of(bits)).bit_count()


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def needed(n: int, m: int, num: int, den: int) -> int:
    return -(-num * (n + m) // (num + den))


def similar(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if num * len(y) > den * len(x):
        return False
    k = np.searchsorted(y, x)
    k[k == len(y)] = 0
    return (num + den) * int((y[k] == x).sum()) >= num * (len(x) + len(y))


def heavy_grams(texts: DataFrame, width: int) -> np.ndarray:
    """N-grams that many documents hold, rarer ones first: HEAVY at most, from counts over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(width)

        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            h = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            c = np.diff(np.append(at, len(h)))
            at, c = at[c >= LOCAL], c[c >= LOCAL]
            return pa.RecordBatch.from_arrays([pa.array(h[at].astype(np.int64)), pa.array(c.astype(np.int64))], ["g", "n"])

        sets, size = [], 0
        for batch in batches:
            for g in grams(batch.column(0)):
                sets.append(g)
                size += len(g)
                if size > BATCH_HASHES:
                    yield counted(sets)
                    sets, size = [], 0
        yield counted(sets)

    top = texts.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(HEAVY).toArrow()
    return top["g"].to_numpy().astype(np.uint64)[::-1]


class Order:
    """The global order as unsigned numbers: hashes below 2 ** 63, heavy n-grams from there by rank."""

    MASK = np.uint64((1 << 22) - 1)

    def __init__(self, heavy: np.ndarray):
        at = np.argsort(heavy)
        self.known, self.rank = heavy[at], at.astype(np.uint64) | np.uint64(1 << 63)
        self.maybe = np.zeros(int(self.MASK) + 1, bool)
        self.maybe[self.known & self.MASK] = True

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        may = np.flatnonzero(self.maybe[grams & self.MASK])
        if not len(may):
            return grams
        k = np.searchsorted(self.known, grams[may])
        k[k == len(self.known)] = 0
        hit = self.known[k] == grams[may]
        if not hit.any():
            return grams
        out = grams.copy()
        out[may[hit]] = self.rank[k[hit]]
        return np.sort(out)


def signatures(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, n (n-grams), node, key, prefix and two sketches of every row; only doc_id and n without words."""
    order = docs.sparkSession.sparkContext.broadcast(Order(heavy_grams(docs, width)))
    names = ["doc_id", "n", "node", "key", "prefix", "sketch", "rough"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(width)
        for batch in batches:
            n, nodes, keys, prefixes, sketches, rough = [], [], [], [], [], []
            for doc, g in zip(batch.column(0).to_pylist(), grams(batch.column(1))):
                n.append(len(g))
                nodes.append(node_of(g) if len(g) else None)
                keys.append(key_of(doc, nodes[-1]) if len(g) else None)
                prefixes.append(order.value(g)[: prefix_length(len(g), num, den)].view(np.int64))
                sketches.append(sketch_of(g) if len(g) else None)
                rough.append(sketch_of(g, ROUGH) if len(g) else None)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes], dtype=np.int64)]).astype(np.int32)
            flat = pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(sketches, pa.binary()), pa.array(rough, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, key long, prefix array<long>, sketch binary, rough binary")


@dataclass
class Leaf:
    node: int
    n: int
    comp: int
    key: int
    tail: int  # n-grams of the prefix behind the runs that the row holds
    early: frozenset[int]  # runs before the tile's block
    sketch: Sketch


class Trie:
    """Paths of (n-gram run, number of n-grams) in one order; every trie node knows the sizes and the longest rest below it."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.root: list = [{}, [], 1 << 62, 0, 0]  # children by run, leaves, least and largest size, longest rest

    def add(self, runs: list[int], counts: list[int], leaf: Leaf) -> None:
        at, rest = self.root, sum(counts) + leaf.tail
        for run, count in zip([*runs, None], [*counts, 0]):
            at[2], at[3], at[4] = min(at[2], leaf.n), max(at[3], leaf.n), max(at[4], rest)
            if run is None:
                at[1].append(leaf)
            else:
                at = at[0].setdefault(run, [{}, [], 1 << 62, 0, 0])
                rest -= count

    def least_shared(self, n: int, m: int) -> int:
        """N-grams that the prefixes of similar sets of n and m must share: what lies behind a prefix can make up no more."""
        num, den = self.num, self.den
        return needed(n, m, num, den) - max(-(-num * n // den), -(-num * m // den)) + 1

    def least_below(self, n: int, least: int, largest: int) -> int:
        """No more than least_shared(n, m) of any m from least to largest.

        Up to n it rises with m. From n on it falls with m but for the two ceilings, which can make a greater m's value
        more than a lesser one's by 1, no more.
        """
        if least == largest:
            return self.least_shared(n, least)
        rising = [self.least_shared(n, least)] if least < n else []
        falling = [self.least_shared(n, largest) - 1] if largest > n else []
        return min(rising + falling)

    def partners(self, runs: list[int], counts: list[int], probe: Leaf) -> Iterator[Leaf]:
        """Leaves of other components that may be similar to probe.

        All paths begin with the tile's block, so that leaves below one trie node share the overlap found so far. A
        subtree is left if the overlap and the lesser of both remaining lengths do not reach what the sizes below ask
        for; a leaf, too, if an earlier run is shared (that run's tiles have the pair), or by its sketch. Runs behind
        those that the rows hold may be shared or not: they count as shared.
        """
        num, den, n = self.num, self.den, probe.n
        where = {r: i for i, r in enumerate(runs)}
        rest = [probe.tail]
        for c in reversed(counts):
            rest.append(rest[-1] + c)
        rest.reverse()  # n-grams of this path from a place on
        low, high = -(-num * n // den), den * n // num
        stack = [(self.root, 0, 0)]  # trie node, overlap, place in this path
        while stack:
            at, overlap, place = stack.pop()
            least, largest = max(low, at[2]), min(high, at[3])
            if least > largest or overlap + probe.tail + min(rest[place], at[4]) < self.least_below(n, least, largest):
                continue
            for leaf in at[1]:
                m = leaf.n
                if leaf.comp != probe.comp and leaf.node != probe.node and low <= m <= high and overlap + probe.tail + leaf.tail >= self.least_shared(n, m) and probe.early.isdisjoint(leaf.early):
                    if probe.sketch.apart(leaf.sketch) <= n + m - 2 * needed(n, m, num, den):
                        yield leaf
            for run, below in at[0].items():
                i = where.get(run)
                if i is None:
                    stack.append((below, overlap, bisect_left(runs, run, place)))
                else:
                    stack.append((below, overlap + counts[i], i + 1))


def walk_tiles(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, i, j and role (the trie's rows first) to one row for each node of a tile that has a partner
    or is one, a probe's row with the nodes of its partners.
    """
    place, trie = None, None
    rows: list[tuple] = []
    named: set[int] = set()
    schema = pa.schema(PARTNERS)

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        for block, i, j, role, node, n, comp, key, sketch, early, runs, counts, tail in zip(*(c.to_pylist() for c in batch.columns)):
            if (block, i, j) != place:
                place, trie = (block, i, j), Trie(num, den)
                named.clear()
            leaf = Leaf(node, n, comp, key, tail, frozenset(early), Sketch(sketch))
            if role == 0:
                trie.add(runs, counts, leaf)
                continue
            found = list(trie.partners(runs, counts, leaf))
            if found:
                rows.append((*place, node, key, comp, [x.node for x in found]))
                for x in found:
                    if x.node not in named:
                        named.add(x.node)
                        rows.append((*place, x.node, x.key, x.comp, []))
            if len(rows) > 20_000:
                yield flush()
    yield flush()


NEAREST = [("a", pa.int64()), ("b", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("off", pa.float64())]
PARTNERS = [("block", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("node", pa.int64()), ("key", pa.int64()), ("comp", pa.int64()), ("partners", pa.list_(pa.int64()))]


def tile_links(batches: Iterator[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, i, j, with texts, to links: one for each merge of two components in a tile."""
    grams = Grams(width)
    place = None
    sets: dict[int, np.ndarray] = {}
    root: dict[int, int] = {}
    comps: dict[int, int] = {}
    wanted: list[tuple[int, list[int]]] = []

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def links() -> pa.RecordBatch:
        a, b = [], []
        for x, others in wanted:
            for y in others:
                if x in sets and y in sets and find(comps[x]) != find(comps[y]) and similar(sets[x], sets[y], num, den):
                    root[find(comps[x])] = find(comps[y])
                    a.append(x)
                    b.append(y)
        for held in (sets, root, comps, wanted):
            held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("block", "i", "j", "node", "comp", "partners")]
        for block, i, j, node, comp, partners, g in zip(*cols, grams(batch.column("text"))):
            if (block, i, j) != place:
                yield links()
                place = (block, i, j)
            sets[node], comps[node] = g, comp
            if partners:
                wanted.append((node, partners))
    yield links()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) of every node on an edge (a, b).

    Each round every node hooks onto its least neighbour, hooks are followed to their ends by doubling, and the
    edges between ends go on; everything stays in tables, lineage is cut each time.
    """
    spark = edges.sparkSession
    found = None
    edges = checkpointed(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not edges.isEmpty():
        up = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.min("b").alias("b"))
        hook = checkpointed(up.select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
        while True:
            ends = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
            far = checkpointed(hook.join(ends, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            hook = far.select("node", "root")
            if far.where("moved").isEmpty():
                break
        ends = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        if found is None:
            found = hook
        else:
            found = checkpointed(found.join(ends, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        a, b = (hook.select(F.col("node").alias(x), F.col("root").alias(x + "r")) for x in "ab")
        edges = checkpointed(edges.join(a, "a").join(b, "b").where("ar != br").select(F.least("ar", "br").alias("a"), F.greatest("ar", "br").alias("b")).distinct())
    return found if found is not None else spark.createDataFrame([], "node long, root long")


class Bitmap:
    """Bits set for ids: 16 an id at least, so that few others pass; nulls always pass."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    @staticmethod
    def spots(ids: np.ndarray, bits: int) -> np.ndarray:
        return ((ids.view(np.uint64) * _C[0]) >> np.uint64(64 - bits)).astype(np.int64)

    def __call__(self, ids: pa.Array) -> np.ndarray:
        s = self.spots(ids.fill_null(0).to_numpy(zero_copy_only=False), self.bits)
        return (self.packed[s >> 3] >> (7 - (s & 7)).astype(np.uint8) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)


def bitmap_of(ids: DataFrame) -> Bitmap | None:
    """A bitmap of a column of ids, of at most 2 ** 28 bits; None for so many ids that it would not sort out any."""
    count = ids.count()
    if count > MOST_MARKED:
        return None
    bits = max(10, (16 * count).bit_length())

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.unique(Bitmap.spots(batch.column(0).drop_null().to_numpy(), bits))
            at, first = np.unique(s >> 3, return_index=True)
            byte = np.bitwise_or.reduceat((128 >> (s & 7)).astype(np.int32), first) if len(s) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(byte, pa.int32())], ["at", "byte"])

    got = ids.mapInArrow(marks, "at long, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte")).toArrow()  # at most 2 ** bits / 8 rows
    packed = np.zeros(1 << (bits - 3), np.uint8)
    packed[got["at"].to_numpy()] = got["byte"].to_numpy()
    return Bitmap(packed, bits)


def with_texts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted (with doc_id and key) and the text of the document that each row's key names.

    Most other documents are left out before the shuffle by a bitmap of ids, the rest by the join on keys. Of repeated
    rows a task hands on one.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(wanted.select("doc_id").distinct()))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, seen = Grams(width), set()
        for batch in batches:
            if bitmap.value is not None:
                batch = batch.filter(pa.array(bitmap.value(batch.column(0))))
            keys, keep = [], []
            for doc, g in zip(batch.column(0).to_pylist(), grams(batch.column(1))):
                key = key_of(doc, node_of(g)) if len(g) else None
                keys.append(key)
                keep.append(key is not None and key not in seen)
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(1)], ["key", "text"]).filter(pa.array(keep, pa.bool_()))

    return docs.select("doc_id", "text").mapInArrow(some, "key long, text string").join(wanted.drop("doc_id"), "key").drop("key")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b), with keys ka and kb, whose whole sets are similar.

    Nodes that are compared with one a meet in as many tasks as FAN asks for, each with one copy of a's text; they pass
    by one at a time.
    """
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fan = checkpointed(pairs.groupBy("a").agg(F.count("*").alias("k"), F.first("ka").alias("ka"))).select("a", "ka", F.least(F.ceil(F.col("k") / FAN), F.lit(n)).cast("int").alias("fans"))
    left = fan.select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(0).alias("kind"), F.col("a").alias("node"), F.col("ka").alias("key"))
    right = pairs.join(fan.select("a", "fans"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int").alias("fan"), F.lit(1).alias("kind"), F.col("b").alias("node"), F.col("kb").alias("key"))
    wanted = checkpointed(left.unionByName(right).join(nodes.select("key", "doc_id"), "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(width)
        key = probe = None
        for batch in batches:
            a, b = [], []
            cols = [batch.column(c).to_pylist() for c in ("a", "fan", "kind", "node")]
            for x, fan, kind, node, g in zip(*cols, grams(batch.column("text"))):
                if kind == 0:
                    key, probe = (x, fan), g
                elif key == (x, fan) and similar(probe, g, num, den):
                    a.append(x)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return with_texts(docs, wanted, width).repartition(n, "a", "fan").sortWithinPartitions("a", "fan", "kind").mapInArrow(run, "a long, b long")


def near_pairs(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that sizes and sketches allow, with keys ka and kb and off (share of n-grams that differ, at least)."""
    for x in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(x), F.col("n").alias("n" + x), F.col("key").alias("k" + x), F.col("sketch").alias("s" + x)), x)
    pairs = pairs.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    schema = pa.schema(NEAREST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = [Sketch(x).apart(Sketch(y)) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist())]
            apart, n, m = np.array(apart, np.int64), batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            fit = apart <= n + m - 2 * -(-num * (n + m) // (num + den))
            cols = [batch.column(c) for c in ("a", "b", "ka", "kb")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(apart / (n + m))], schema=schema).filter(pa.array(fit))

    return pairs.select("a", "b", "na", "nb", "ka", "kb", "sa", "sb").mapInArrow(run, "a long, b long, ka long, kb long, off double")


def nearest(pairs: DataFrame) -> DataFrame:
    """For each b the pair that differs least."""
    return pairs.groupBy("b").agg(F.min(F.struct("off", "a", "ka", "kb")).alias("p")).select("p.a", "b", "p.ka", "p.kb")


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two nodes are not in one component."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(x + "r")) for x in "ab")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ar", "a") != F.coalesce("br", "b")).drop("ar", "br")


def similar_groups(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links lead to), set_id and root (of the component) of every row.

    A text is lower-cased (A to Z) and split at ASCII white space. Null texts and texts without a word have no set:
    they link with nothing and are their own component. Equal sets are linked, repeated rows too. Null ids are
    passed over for component_id; a component of null ids only has none. An empty table gives an empty result;
    other columns are not read. Texts of any length are read whole, in slices; a set of n-grams takes 8 bytes each in
    the task that compares it. Hashes have 63 and 64 bits: in a billion documents, two different sets get one
    node with a chance of 3 in 100.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with tidy(docs.sparkSession):
        return _similar_groups(docs, width, num, den)


def _similar_groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    wide = checkpointed(signatures(docs, width, num, den))
    sig = checkpointed(wide.select("doc_id", "n", "node"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "key")).alias("one")
    nodes = wide.where("node is not null").groupBy("node").agg(one, F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.first("rough").alias("rough"))
    prefixes = checkpointed(nodes.select("node", "one.doc_id", "one.key", "n", "prefix", "sketch", "rough"))
    discard(wide)  # each table goes as soon as a smaller one has what is read later

    members = checkpointed(block_members(prefixes))
    nodes = checkpointed(prefixes.drop("prefix"))
    discard(prefixes)
    leads = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    leads = checkpointed(near_pairs(leads, nodes, num, den))
    links = checkpointed(verified(nearest(leads), docs, nodes, width, num, den))
    roots = components(links)
    more = checkpointed(apart(leads, roots))
    if not more.isEmpty():
        links = checkpointed(links.unionByName(verified(more, docs, nodes, width, num, den)))
        roots = components(links)
    tiles = tile_rows(members, roots, nodes, num, den)
    if tiles is not None:
        found = checkpointed(tiles.mapInArrow(lambda it: walk_tiles(it, num, den), "block long, i long, j long, node long, key long, comp long, partners array<long>"))
        links = checkpointed(links.unionByName(compared(found, docs, nodes, width, num, den)))
        roots = components(links)

    least = nodes.join(roots, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = nodes.select("node", "doc_id").join(roots, "node", "left").join(least, "root", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "node").alias("root"))
    out = sig.select("doc_id", "n", "node").join(named, "node", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("node").isNull(), F.col("doc_id")), F.col("component_id")).alias("component_id"), F.col("node").alias("set_id"), "root")
    return checkpointed(out, lasting=True)


def block_members(nodes: DataFrame) -> DataFrame:
    """block, node, n, count (n-grams of the block) and lead (its least node), of n-grams that the prefixes of two nodes or more have.

    N-grams with the same nodes are one block: blocks are told apart by number and exclusive or of their nodes, which
    are hashes; should two blocks get one name, their nodes are only compared once too often.
    """
    grams = nodes.select("node", "n", F.explode("prefix").alias("g"))
    block = grams.groupBy("g").agg(F.count("*").alias("k"), F.bit_xor("node").alias("x"), F.min("node").alias("lead")).where("k > 1")
    block = checkpointed(block.select("g", F.xxhash64("k", "x", "lead").alias("block"), "lead"))
    return grams.join(block, "g").groupBy("block", "node").agg(F.count("*").cast("int").alias("count"), F.min("lead").alias("lead"), F.min("n").alias("n"))


def tile_rows(members: DataFrame, roots: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame | None:
    """Rows of the tiles of all blocks with more than one component, dealt and sorted for walk_tiles; None without any.

    A block's least node is left out: it has been compared with all others. Nodes are put in classes by size, so that
    similar ones are in one class or in two next to each other; only such classes meet in a tile. Those of a block's largest
    component are cut into tiles apart from the few others and do not probe.

    A row has the node's next runs from the tile's block on, and some before it; so a long path is not repeated whole
    for each of its blocks. Two nodes are compared in the tile of the first block that both have, or again in a later
    one if more than BEHIND runs lie between.
    """
    spark = members.sparkSession
    size_class = F.floor(F.log(F.col("n").cast("double")) / (math.log(den / num) * 1.000001)).cast("int")
    m = members.where("node != lead").select("block", "node", "n", size_class.alias("cls")).join(roots, "node", "left").select("block", "node", "n", "cls", F.coalesce("root", "node").alias("comp"))
    m = checkpointed(with_partners(m.join(members.groupBy("node").agg(F.sum("count").alias("shared")), "node"), num, den))
    parts = m.groupBy("block", "comp", "cls").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    whole = parts.groupBy("block", "comp").agg(F.sum("c").alias("c")).groupBy("block").agg(F.max(F.struct("c", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    parts = parts.join(whole.select("block", F.col("top.comp").alias("top")), "block").withColumn("in_big", F.col("comp") == F.col("top"))
    of = lambda x, big: F.coalesce(F.sum(F.when(F.col("in_big") == big, F.col(x))), F.lit(0))
    tiles = lambda big: F.ceil(F.greatest(of("c", big) / TILE, of("w", big) / TILE_GRAMS)).cast("int")
    classes = parts.groupBy("block", "cls").agg(F.first("top").alias("top"), tiles(False).alias("few"), tiles(True).alias("big"), F.sum("c").alias("c"))
    state = checkpointed(classes.groupBy("block").agg(F.first("top").alias("top"), F.collect_list(F.struct("cls", "few", "big", "c")).alias("classes")))  # a few classes a block
    if state.isEmpty():
        return None
    m = m.join(state, "block")
    own = lambda step, x: F.coalesce(F.get(F.filter("classes", lambda k: k["cls"] == F.col("cls") + step), F.lit(0))[x], F.lit(0)).cast("int")
    m = m.withColumns({"in_big": F.col("comp") == F.col("top"), "c": own(0, "c")} | {x + k: own(step, x) for k, step in (("0", 0), ("u", 1), ("d", -1)) for x in ("few", "big")})
    spot = F.xxhash64("node", F.lit(3))
    m = m.withColumn("tile", F.when(F.col("in_big"), F.col("few0") + F.pmod(spot, F.col("big0"))).otherwise(F.pmod(spot, F.col("few0"))).cast("int"))
    name = lambda step, t: F.shiftleft((F.col("cls") + step).cast("long"), 32) + t

    def some(step: int, first: Column, last: Column, where: Column) -> Column:
        """Names of the tiles from first to last of a class next to this one, or of this one."""
        return F.transform(F.when(where & (first <= last), F.sequence(first, last)).otherwise(F.expr("cast(array() AS array<int>)")), lambda t: name(step, t))

    zero, yes, few, big = F.lit(0), F.lit(True), lambda k: F.col("few" + k), lambda k: F.col("big" + k)
    probed = F.concat(some(0, F.col("tile"), few("0") + big("0") - 1, F.col("c") > 1), some(1, zero, few("u") + big("u") - 1, yes), some(-1, few("d"), few("d") + big("d") - 1, yes))
    probing = F.concat(some(0, zero, F.least(F.col("tile"), few("0") - 1), F.col("c") > 1), some(-1, zero, few("d") - 1, yes), some(1, zero, few("u") - 1, F.col("in_big")))
    m = m.select("block", "node", "n", "comp", name(0, F.col("tile")).alias("tile"), F.when(F.col("in_big"), F.expr("cast(array() AS array<bigint>)")).otherwise(probed).alias("probed"), probing.alias("probing"))
    m = checkpointed(m.where((F.size("probed") > 0) | (F.size("probing") > 0)))
    open_nodes = m.select("node").distinct()
    paths = members.join(open_nodes, "node", "left_semi").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("block", "count"))).alias("path"))
    paths = paths.join(nodes.select("node", "key", F.col("rough").alias("sketch")), "node")
    m = m.join(paths, "node").withColumn("at", F.array_position("path.block", F.col("block")).cast("int"))
    early = F.slice(F.col("path.block"), F.greatest(F.lit(1), F.col("at") - BEHIND), F.least(F.lit(BEHIND), F.col("at") - 1))
    tail = F.aggregate(F.slice(F.col("path.count"), F.col("at") + AHEAD, F.size("path")), F.lit(0), lambda s, x: s + x)
    m = m.select("block", "tile", "probed", "probing", "node", "n", "comp", "key", "sketch", early.alias("early"), F.slice(F.col("path.block"), F.col("at"), AHEAD).alias("runs"), F.slice(F.col("path.count"), F.col("at"), AHEAD).alias("counts"), tail.alias("tail"))
    places = F.concat(F.transform("probed", lambda t: F.struct(F.col("tile").alias("i"), t.alias("j"), F.lit(1).alias("role"))), F.transform("probing", lambda t: F.struct(t.alias("i"), F.col("tile").alias("j"), F.lit(0).alias("role"))))
    rows = m.withColumn("place", F.explode(places)).select("block", "place.i", "place.j", "place.role", "node", "n", "comp", "key", "sketch", "early", "runs", "counts", "tail")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j", "role")


def with_partners(m: DataFrame, num: int, den: int) -> DataFrame:
    """Members of the blocks with more than one component; of blocks up to PEERS, only those that may have a partner there.

    shared counts the n-grams of a node's prefix that any other prefix has: no pair shares more than the lesser of both.
    """
    m = checkpointed(m)
    blocks = m.groupBy("block").agg(F.count("*").alias("k"), F.min("comp").alias("least"), F.max("comp").alias("most")).where("least != most")
    m = checkpointed(m.join(blocks.select("block", "k"), "block"))
    peers = m.where(F.col("k") <= PEERS).groupBy("block").agg(F.collect_list(F.struct("n", "shared", "comp")).alias("peers"))
    up = lambda x, y: F.floor((x + (y - 1)) / y)

    def fits(p: Column) -> Column:
        n, o = F.col("n"), p["n"]
        lesser, greater = F.least(n, o), F.greatest(n, o)
        least_shared = up(num * (n + o), num + den) - up(num * greater, den) + 1
        return (p["comp"] != F.col("comp")) & (lesser * den >= greater * num) & (F.least(F.col("shared"), p["shared"]) >= least_shared)

    m = m.join(peers, "block", "left").where(F.col("peers").isNull() | F.exists("peers", fits))
    return m.select("block", "node", "n", "cls", "comp")


def compared(found: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links of the tiles' rows that walk_tiles found, on whole sets; of a node's rows in a tile, only one needs the text."""
    found = found.groupBy("block", "i", "j", "node").agg(F.first("key").alias("key"), F.first("comp").alias("comp"), F.flatten(F.collect_list("partners")).alias("partners"))
    wanted = checkpointed(found.join(nodes.select("key", "doc_id"), "key"))
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_texts(docs, wanted, width).repartition(n, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return rows.mapInArrow(lambda it: tile_links(it, width, num, den), "a long, b long")


def one_of_each_group(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The rows of docs without those that are similar to another: of each group the row with the least doc_id stays.

    Of repeated rows one stays; a null id stays only in a group without others; rows without words all stay.
    Every column is kept, whatever its name. Only rows of groups with more than one row are shuffled with their texts.
    """
    named = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    groups = checkpointed(similar_groups(named, width, num, den).where("root is not null").groupBy("root", "doc_id", "set_id").agg(F.count("*").alias("c")))
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "set_id")).alias("w"))
    stay = least.select(F.col("w.doc_id").alias("own_id"), F.col("w.set_id").alias("own_set"))
    same = (F.col("doc_id").eqNullSafe(F.col("own_id"))) & (F.col("set_id") == F.col("own_set"))
    unsure = groups.where("c > 1").select("doc_id").unionByName(groups.join(stay, same, "left_anti").select("doc_id"))
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(unsure.distinct()))
    at, text_at = named.columns.index("doc_id"), named.columns.index("text")
    own, sets = fresh_name(named, "own_key"), fresh_name(named, "set_key")
    schema = T.StructType([*named.schema.fields, T.StructField(sets, T.LongType())])
    maybe = lambda batch: bitmap.value(batch.column(at)) if bitmap.value is not None else np.ones(batch.num_rows, bool)

    def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~maybe(batch)))

    def other(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(width)
        for batch in batches:
            batch = batch.filter(pa.array(maybe(batch)))
            found = [key_of(doc, node_of(g)) if len(g) else None for doc, g in zip(batch.column(at).to_pylist(), grams(batch.column(text_at)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, sets])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([key_of(d, s) for d, s in zip(*(c.to_pylist() for c in batch.columns))], pa.int64())], [own])

    rest = named.mapInArrow(other, schema)
    keys = stay.mapInArrow(keyed, T.StructType([T.StructField(own, T.LongType())]))
    kept = rest.join(keys, rest[sets] == keys[own], "left_semi").dropDuplicates([sets])
    bare = rest.where(F.col(sets).isNull())
    return named.mapInArrow(sure, named.schema).unionByName(kept.drop(sets)).unionByName(bare.drop(sets))
