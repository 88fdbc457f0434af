"""Packing by power-of-two decomposition.

A document of T tokens is cut into T // cap pieces of cap tokens and one piece for each set bit of
T % cap, longest first. Every piece is a sequence of its own whose length is a power of two, so
sequences of one length can be batched without padding and none crosses a document.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Bounded, id_and_text, texts_of

CAP = 1024
#: Below this code point the rank file and the tokenizer file cut text alike in every Unicode version.
PLAIN_BELOW = "ɐ"
_SPACES = re.compile(r"\s\s")


class ByteBpe(Bounded):
    """Ids of a byte-level BPE as little-endian 32-bit bytes, kept by space-separated unit.

    A single space before a non-space always starts a new pre-token, so a text without adjacent white
    space is the concatenation of its units' ids. Other texts, and those that name a special token, go
    to the tokenizer whole.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str, most: int = 400_000):
        super().__init__(most)
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(json_path)
        self.full.no_truncation()
        self.full.no_padding()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]

    def make(self, unit: str) -> bytes:
        if max(unit, default="") < PLAIN_BELOW:
            return array("I", self.plain.encode_ordinary(unit)).tobytes()
        return self.whole(unit)

    def whole(self, text: str) -> bytes:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special) or _SPACES.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return self[first] + b"".join([self[" " + u] for u in rest]) if text else b""


def pieces(n: int, cap: int = CAP) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; cap is a power of two."""
    start = 0
    for length in [cap] * (n // cap) + [1 << b for b in range(cap.bit_length() - 2, -1, -1) if n % cap >> b & 1]:
        yield start, length
        start += length


def default_files() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def pack(docs: DataFrame, cap: int = CAP, end_id: int = 0, with_ids: bool = False, files: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (and ids).

    Null and empty texts are one piece that holds end_id only. Repeated rows are packed each for itself;
    a null doc_id stays null; other columns of docs are not read. sequence_id is unique; bucket is the
    binary logarithm of the length: sequences of one bucket batch without padding. One pass, no shuffle:
    a task holds one batch, and a lost task repeats its own split with the same sequence_ids.
    """
    if cap < 1 or cap & (cap - 1):
        raise ValueError("cap must be a power of two")
    files = files or default_files()
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*files)
        for batch in batches:
            rows: list[tuple] = []
            ids: list = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch)):
                data = bpe.ids(text or "") + end
                n = len(data) // 4
                for start, length in pieces(n, cap):
                    part = data[4 * start : 4 * (start + length)]
                    rows.append((doc, start, length, zlib.crc32(part), n))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int64))
            cols = [pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields)]
            names = [n for n, _ in fields]
            if with_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    out = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
    return out.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long"), "bucket": F.log2(F.col("length")).cast("int")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences in one folder per length, for readers that batch equal lengths."""
    packed.write.partitionBy("bucket").parquet(path)
