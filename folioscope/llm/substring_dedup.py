"""Removal of word sequences that stand in an earlier document, by compacting paths of a De Bruijn graph.

The graph's edges are the k-mers of WIDTH words (its nodes have a word less); a text is a path in it.

1. Edges: each window of words is hashed to an edge. A task keeps an edge once for a slice of documents, with the smallest document
   that has it; the edges are dealt by hash into buckets, and each bucket finds the smallest document of all: the edge's
   source. An edge in a third of all documents is thus one entry a slice, not one a document.
2. Paths: documents are joined with what was found of their edges. Neighbouring edges with one source are a path that
   does not branch, and become one span: its place, its words, and the source where it should stand.
3. Verification: spans are joined with the texts of their sources. The source's coordinates come from the span's first edge;
   from there both are compared word by word, as far as they agree, and again from the next edge where they part. A
   source that very many spans name is copied, and its spans are spread over the copies.
4. A window that its source does not hold (two k-mers with one hash) is looked for by its words in all documents.

So hashes only propose; each removal was seen on words.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bytes_of, checkpointed, discard, tidy
from folioscope.llm.word_stream import Hashed, joined

WIDTH = 13
#: Words and documents of a slice at most (a longer document is a slice of its own); windows of a bucket, about.
SLICE_WORDS, SLICE_DOCS, BUCKET_WINDOWS = 2_000_000, 60_000, 2_000_000
LEAST_BITS = 7
#: Bytes of spans that one copy of a source is compared with; sources with more are spread, HOT of them at most.
COPY_BYTES, HOT = 4 << 20, 10_000
#: Bits of the sketch of windows that are looked for by their words.
SKETCH = 1 << 22
_LOW = np.uint64((1 << 48) - 1)
#: Low bits that a key loses on its way to its documents: there it is told from the other keys of one document only.
SHORT = np.uint64(12)


@dataclass(frozen=True)
class Graph:
    """Edges of `width` words; numbers of 1 << bits buckets. `strength`: bits of an edge's hash inside its bucket."""

    width: int = WIDTH
    bits: int = LEAST_BITS
    strength: int = 48

    @property
    def homes(self) -> int:
        """Groups in which documents meet what was found of their edges; an odd number, so that ids in steps spread. Of many buckets
        each has a row for each group, so groups become more slowly: 129 for 128 buckets, 1,025 for 4,096."""
        return (1 << (3 * self.bits + 7) // 4) + 1

    def keys(self, w: np.ndarray) -> np.ndarray:
        """Edges of all windows of hashed words; the bucket stands in the bits from 48 on."""
        n = len(w) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for j in range(self.width):
            h += w[j : n + j] * np.uint64(xxhash.xxh3_64_intdigest(b"%d" % j) | 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h >>= np.uint64(16 - self.bits)
        return h >> np.uint64(48 - self.strength) << np.uint64(48 - self.strength)


def groups_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def packed(values: np.ndarray, width: int) -> bytes:
    """The lowest `width` bits of each value, without gaps."""
    k = -(-width // 8)
    return np.packbits(np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - k :], axis=1)[:, 8 * k - width :]).tobytes()


def unpacked(data: bytes, n: int, width: int) -> np.ndarray:
    k = -(-width // 8)
    bits = np.zeros((n, 8 * k), np.uint8)
    bits[:, 8 * k - width :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width).reshape(n, width)
    out = np.zeros((n, 8), np.uint8)
    out[:, 8 - k :] = np.packbits(bits, axis=1)
    return out.view(">u8").ravel().astype(np.uint64)


_HEAD = struct.Struct("<IBQI")


def ascending(values: np.ndarray) -> bytes:
    """Integers in ascending order: 2 bits each and the logarithm of their mean step (Elias-Fano code)."""
    values = values.view(np.uint64)
    v, n = values - values[0], len(values)
    low = max(0, (int(v[-1]) // n).bit_length() - 1)
    high = (v >> np.uint64(low)).astype(np.int64)
    marks = np.zeros(n + int(high[-1]), np.uint8)
    marks[high + np.arange(n)] = 1
    tail = np.packbits(marks).tobytes()
    return _HEAD.pack(n, low, int(values[0]), len(tail)) + packed(v, low) + tail


def ascended(data: bytes) -> tuple[np.ndarray, int]:
    """The integers of ascending(), as unsigned ones, and where they end in data."""
    n, low, first, size = _HEAD.unpack_from(data)
    at = _HEAD.size + (n * low + 7) // 8
    high = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at))) - np.arange(n)
    return (high.astype(np.uint64) << np.uint64(low) | unpacked(data[_HEAD.size : at], n, low)) + np.uint64(first), at + size


def places(n: int) -> int:
    """Bits of a number below n."""
    return (n - 1).bit_length()


def found_bytes(docs: np.ndarray, keys: np.ndarray, sources: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """docs in ascending order; keys without their SHORT low bits, as differences to the least; sources as distinct ones and places in them."""
    keys = keys >> SHORT
    least = keys.min()
    keys -= least
    width = int(keys.max()).bit_length()
    used, at = np.unique(sources, return_inverse=True)
    return ascending(docs), _HEAD.pack(len(keys), width, int(least), 0) + packed(keys, width), ascending(used) + packed(at, places(len(used)))


def found_arrays(docs: bytes, keys: bytes, sources: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of found_bytes(); keys stay short."""
    n, width, least, _ = _HEAD.unpack_from(keys)
    used, end = ascended(sources)
    at = unpacked(sources[end:], n, places(len(used))).astype(np.int64)
    return ascended(docs)[0].view(np.int64), unpacked(keys[_HEAD.size :], n, width) + np.uint64(least), used.view(np.int64)[at]


def to_homes(docs: np.ndarray, keys: np.ndarray, sources: np.ndarray, homes: int) -> list[tuple]:
    """home, and as bytes docs, keys and sources of that home, by document; and a row for each document that is a source (of itself)."""
    marks = np.unique(sources)  # its text will be asked for
    docs, keys, sources = np.concatenate([docs, marks]), np.concatenate([keys, np.full(len(marks), keys[0])]), np.concatenate([sources, marks])
    home = np.mod(docs, homes)
    order = np.lexsort((docs, home))
    docs, keys, sources, home = docs[order], keys[order], sources[order], home[order]
    edges = [*groups_of(home).tolist(), len(home)]
    return [(int(home[a]), *found_bytes(docs[a:b], keys[a:b], sources[a:b])) for a, b in zip(edges, edges[1:])]


#: bucket; home (null: these are edges of the bucket), docs, keys, sources. Of edges: distinct documents, keys without their bucket, and the
#: places of the keys' documents in docs. An edge takes about 6 bytes, 7 where buckets are so many that a slice has few edges for each.
_ROWS = pa.schema([("bucket", pa.int32()), ("home", pa.int32()), ("docs", pa.binary()), ("keys", pa.binary()), ("sources", pa.binary())])
ROWS = "bucket int, home int, docs binary, keys binary, sources binary"


def as_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _ROWS)], schema=_ROWS)


def slice_rows(ids: list[int], words: list[np.ndarray], graph: Graph) -> list[tuple]:
    """Rows of one slice of documents in order of their ids: its edges by bucket, and repeats inside the slice."""
    doc_ids, doc_of = np.unique(np.array(ids, np.int64), return_inverse=True)
    sizes = np.array([len(w) for w in words])
    keys = graph.keys(np.concatenate(words))
    doc = np.repeat(doc_of, sizes)[: len(keys)]
    stop = np.repeat(np.cumsum(sizes), sizes)[: len(keys)]
    inside = np.arange(len(keys)) + graph.width <= stop
    keys, doc = keys[inside], doc[inside]
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = groups_of(keys)
    least = np.repeat(doc[first], np.diff(np.r_[first, len(keys)]))
    again = doc > least
    rows: list[tuple] = []
    if again.any():
        rows += [(h % (1 << graph.bits), h, *x) for h, *x in to_homes(doc_ids[doc[again]], keys[again], doc_ids[least[again]], graph.homes)]
    keys, doc = keys[first], doc[first]
    bucket = (keys >> np.uint64(48)).astype(np.int64)
    edges = [*groups_of(bucket).tolist(), len(bucket)]
    for a, b in zip(edges, edges[1:]):
        used, at = np.unique(doc[a:b], return_inverse=True)
        rows.append((int(bucket[a]), None, ascending(doc_ids[used]), ascending(keys[a:b] & _LOW), packed(at, places(len(used)))))
    return rows


def edges(docs: DataFrame, graph: Graph) -> DataFrame:
    """ROWS of all slices; docs: doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed()
        for batch in batches:
            texts = bytes_of(batch)
            ids, words, size = [], [], 0
            for doc, i in sorted(zip(batch.column(0).to_pylist(), range(len(texts)))):
                w = hashed.hashes(texts[i] or b"")
                if ids and (size + len(w) > SLICE_WORDS or len(ids) >= SLICE_DOCS):
                    yield as_rows(slice_rows(ids, words, graph))
                    ids, words, size = [], [], 0
                if len(w) >= graph.width:
                    ids.append(doc)
                    words.append(w)
                    size += len(w)
            if ids:
                yield as_rows(slice_rows(ids, words, graph))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, ROWS)


def sources_of(rows: DataFrame, graph: Graph) -> DataFrame:
    """home, docs, keys, sources: each edge that is in a smaller document, too, and each document that is a source."""
    schema = pa.schema([f for f in _ROWS if f.name != "bucket"])

    def bucket(table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        docs, keys = [], []
        for _, home, d, k, s in zip(*[c.to_pylist() for c in table.columns]):
            if home is not None:
                out.append((home, d, k, s))
                continue
            used, low = ascended(d)[0].view(np.int64), ascended(k)[0]
            docs.append(used[unpacked(s, len(low), places(len(used))).astype(np.int64)])
            keys.append(low)
        if docs:
            top = np.uint64(table.column("bucket")[0].as_py()) << np.uint64(48)
            doc, key = np.concatenate(docs), np.concatenate(keys)
            del docs, keys
            order = np.argsort(key, kind="stable")
            doc, key = doc[order], key[order] | top
            first = groups_of(key)
            least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.r_[first, len(key)]))
            more = doc > least
            if more.any():
                out += to_homes(doc[more], key[more], least[more], graph.homes)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    return rows.groupBy("bucket").applyInArrow(bucket, "home int, docs binary, keys binary, sources binary")


SPANS = "source long, kind int, doc_id long, text_hash long, start long, n long, words binary"
_SPANS = pa.schema([("source", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])
SOURCE, SPAN = 0, 1


def as_spans(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _SPANS)], schema=_SPANS)


def text_hash() -> F.Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def spans(docs: DataFrame, found: DataFrame, graph: Graph) -> DataFrame:
    """SPANS: texts of sources (kind SOURCE, all its words), and paths (kind SPAN) of n windows from word `start` of a document."""
    text = docs.where("doc_id IS NOT NULL").select(F.pmod("doc_id", F.lit(graph.homes)).cast("int").alias("home"), F.lit(1).alias("kind"), "doc_id", text_hash().alias("h"), F.col("text").cast("binary").alias("a"), *[F.lit(None).cast("binary").alias(c) for c in "bc"])
    known = found.select("home", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("h"), F.col("docs").alias("a"), F.col("keys").alias("b"), F.col("sources").alias("c"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = known.unionByName(text).repartition(n, "home").sortWithinPartitions("home", "kind")

    def of_document(doc: int, h: int, data: bytes, keys: np.ndarray, sources: np.ndarray, hashed: Hashed) -> Iterator[tuple]:
        own = sources == doc
        if own.any():
            yield (doc, SOURCE, None, None, None, None, data)
        keys, sources = keys[~own], sources[~own]
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, sources = keys[order], sources[order]
        mine = graph.keys(hashed.hashes(data)) >> SHORT
        at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
        hit = keys[at] == mine
        source = sources[at]
        begin = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (source[1:] != source[:-1])]) if len(mine) else []
        if not len(begin):
            return
        end = np.flatnonzero(hit & np.r_[~hit[1:] | (source[1:] != source[:-1]), True])
        words = data.split()
        for i, j in zip(begin.tolist(), end.tolist()):
            yield (int(source[i]), SPAN, doc, h, i, j - i + 1, b" ".join(words[i : j + graph.width]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, home, closed = Hashed(), None, True
        parts: list[tuple] = []
        docs = keys = sources = np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for at, kind, doc, h, a, b, c in zip(*[x.to_pylist() for x in batch.columns]):
                if at != home or (kind == 0 and closed):
                    home, parts, closed = at, [], False
                if kind == 0:
                    parts.append((a, b, c))
                    continue
                if not closed:
                    arrays = [found_arrays(*x) for x in parts]
                    docs, keys, sources = (np.concatenate([x[k] for x in arrays] or [np.zeros(0, t)]) for k, t in enumerate((np.int64, np.uint64, np.int64)))
                    del arrays
                    order = np.argsort(docs, kind="stable")
                    docs, keys, sources, parts, closed = docs[order], keys[order], sources[order], [], True
                lo, hi = np.searchsorted(docs, doc), np.searchsorted(docs, doc, "right")
                if hi > lo:
                    for row in of_document(doc, h, a or b"", keys[lo:hi], sources[lo:hi], hashed):
                        out.append(row)
                        size += len(row[-1])
                    if size > 16 << 20:
                        yield as_spans(out)
                        out, size = [], 0
            if out:
                yield as_spans(out)

    return rows.mapInArrow(run, SPANS)


def spread(rows: DataFrame) -> DataFrame:
    """SPANS rows with copy: spans of a source with very many are dealt to copies of it."""
    size = rows.where(F.col("kind") == SPAN).groupBy("source").agg(F.sum(F.length("words")).alias("bytes"))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    hot = size.where(F.col("bytes") > max(COPY_BYTES, total // HOT)).select("source", F.ceil(F.col("bytes") / COPY_BYTES).cast("int").alias("copies"))
    marked = rows.join(F.broadcast(hot), "source", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    copies = F.when(F.col("kind") == SOURCE, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "start"), F.col("copies")).cast("int")))
    return marked.withColumn("copy", F.explode(copies)).select("source", "copy", "kind", "doc_id", "text_hash", "start", "n", "words")


RANGES = "doc_id long, text_hash long, start long, n long, words binary"
_RANGES = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("words", pa.binary())])


def agreed(words: list[bytes], at: int, other: list[bytes], there: int) -> int:
    """For how many words the two go on alike."""
    most, n = min(len(words) - at, len(other) - there), 0
    if words[at : at + most] == other[there : there + most]:
        return most
    step = 64
    while words[at + n : at + n + step] == other[there + n : there + n + step]:
        n += step
    while n < most and words[at + n] == other[there + n]:
        n += 1
    return min(n, most)


def verified(rows: DataFrame, graph: Graph) -> DataFrame:
    """RANGES: windows that were seen in their source (words null), and single windows that were not (their words)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "source", "copy").sortWithinPartitions("source", "copy", "kind").select("source", "copy", "kind", "doc_id", "text_hash", "start", "n", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, key, texts, known = Hashed(), None, [], False
        words: list[bytes] = []
        order = sorted_keys = np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple] = []
            for source, copy, kind, doc, h, start, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                if (source, copy) != key:
                    key, texts, known = (source, copy), [], False
                if kind == SOURCE:
                    texts.append(data)
                    continue
                if not known:  # several rows of one id are looked through together, parted by words that no text has
                    words = [w for t in texts for w in [*t.split(), b"\n"]]
                    keys = graph.keys(np.concatenate([x for t in texts for x in (hashed.hashes(t), np.ones(1, np.uint64))] or [np.zeros(0, np.uint64)]))
                    order = np.argsort(keys, kind="stable")
                    sorted_keys, known = keys[order], True
                mine = data.split()
                keys = graph.keys(hashed.hashes(data))
                at = np.searchsorted(sorted_keys, keys)
                i = 0
                while i < n:
                    best, k = 0, int(at[i])
                    while k < len(sorted_keys) and sorted_keys[k] == keys[i]:
                        best = max(best, agreed(mine, i, words, int(order[k])))
                        if best == len(mine) - i:
                            break
                        k += 1
                    if best >= graph.width:
                        out.append((doc, h, start + i, best - graph.width + 1, None))
                        i += best - graph.width + 1
                    else:
                        out.append((doc, h, start + i, 1, b" ".join(mine[i : i + graph.width])))
                        i += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RANGES)], schema=_RANGES)

    return rows.mapInArrow(run, RANGES)


def by_words(docs: DataFrame, doubtful: DataFrame, width: int) -> DataFrame:
    """RANGES of those doubtful windows whose words begin in a smaller document; all documents are looked through."""
    spot = F.pmod(F.xxhash64("words"), F.lit(SKETCH)).cast("int")
    spots = np.zeros(SKETCH, bool)
    spots[[r[0] for r in doubtful.select(spot.alias("s")).distinct().collect()]] = True  # SKETCH numbers at most
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(spots))
    seed = 42  # as the SQL function has it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(sent.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, data in zip(batch.column(0).to_pylist(), bytes_of(batch)):
                w = (data or b"").split()
                for i in range(len(w) - width + 1):
                    x = b" ".join(w[i : i + width])
                    if flags[_signed(xxhash.xxh64_intdigest(x, seed)) % SKETCH]:
                        out.append((doc, x))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], ["doc_id", "words"])

    seen = docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, "doc_id long, words binary")
    least = seen.groupBy("words").agg(F.min("doc_id").alias("least"))
    return doubtful.join(least, "words").where("least < doc_id").select("doc_id", "text_hash", "start", "n", F.lit(None).cast("binary").alias("words"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def removed(docs: DataFrame, ranges: DataFrame, width: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept, of every row of docs."""
    # ranges grow with the documents and are broadcast at no size
    cut = ranges.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("cut")).hint("merge")
    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text").join(cut, ["doc_id", "text_hash"], "left").select("doc_id", "text", F.col("cut.start").alias("start"), F.col("cut.n").alias("n"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, data, starts, ns in zip(batch.column(0).to_pylist(), bytes_of(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = data or b""
                if starts is None:
                    words = data.split()
                    out.append((doc, len(words), 0, b" ".join(words).decode("utf-8", "replace")))
                    continue
                n = len(data.split())
                step = np.zeros(n + 1, np.int64)
                np.add.at(step, starts, 1)
                np.add.at(step, np.array(starts) + np.array(ns) + width - 1, -1)
                keep = np.cumsum(step[:n]) == 0
                out.append((doc, n, n - int(keep.sum()), joined(data, keep)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], ["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(docs: DataFrame, width: int = WIDTH, strength: int = 48) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, one space between).

    A word goes if it is covered by `width` words that also stand in a document with a smaller doc_id. Repeats inside a document
    stay; so do those of rows with one doc_id, none of which is smaller, and those of rows without doc_id, which are nobody's
    source. A null or empty text has no words; a text of fewer than `width` words keeps them all. An empty table gives an
    empty result. Other columns are not read. Texts are read whole; very long ones are hashed in slices. The result does not
    depend on `strength` (see Graph). The ranges to remove are found in the call and kept; texts are cut as the result is read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with tidy(docs.sparkSession):
        # about 6 bytes a word; the number of buckets alone depends on it
        windows = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
        bits = min(16, max(LEAST_BITS, math.ceil(math.log2(max(1.0, windows / BUCKET_WINDOWS)))))
        graph = Graph(width, bits, strength)
        found = checkpointed(sources_of(edges(docs, graph), graph))
        paths = checkpointed(spans(docs, found, graph))
        discard(found)
        ranges = checkpointed(verified(spread(paths), graph))
        discard(paths)
        doubtful = ranges.where("words IS NOT NULL")
        sure = ranges.where("words IS NULL")
        if not doubtful.isEmpty():
            sure = sure.unionByName(by_words(docs, doubtful, width))
        sure = checkpointed(sure, lasting=True)
    return removed(docs, sure, width)
