"""Media columns in a store of content-defined chunks.

A document's bytes become an 8-bit mono WAV file. A rolling gear hash cuts the file into chunks, so equal
passages give equal chunks wherever they stand; every chunk is stored once under its digest, and a document
keeps the ordered list of its digests. Reading joins the lists with the store, checks every digest and
puts the file together again.

Chunks that only one document holds are written with that document, shared chunks once under their digest.
Which chunks may be shared is known from a first pass over digests alone; it is handed to the tasks as a
bitmap of fixed size. A wrong "may be shared" only sends a chunk the longer way, so results are exact.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bytes_of, shared_dir

UNIT, PAD = 192, b" "
LEAST, MEAN_BITS, MOST = 1024, 12, 16_384
RATE = 8000
#: The bitmap of digests that may be shared has 2 ** BITS bits: two megabytes, whatever the data.
BITS = 24
_WORD = 24  # bits used of each number that makes it up
#: A task hands on what it has made at about so many bytes.
FLUSH = 16 << 20


def gear_table(seed: int = 5) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.sha256(bytes([seed, b])).digest()[:4] for b in range(256)), "<u4").copy()


GEAR = gear_table()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks: where the top bits of the gear hash of the last 32 bytes are 0, LEAST to MOST bytes apart."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # the sum of GEAR[byte] << age over the last 2k bytes
        older = h[:-k] << np.uint32(k)
        h = h.copy()
        h[k:] += older
    found, start = [], 0
    for i in (np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1).tolist():
        while i - start > MOST:
            start += MOST
            found.append(start)
        if i - start >= LEAST:
            found.append(i)
            start = i
    while n - start > MOST:
        start += MOST
        found.append(start)
    return found + [n] if start < n else found


def payload(text: bytes | None) -> bytes:
    text = text or b""
    return text + PAD * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def wav(samples: bytes) -> bytes:
    odd = len(samples) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * odd


def samples_of(file: bytes) -> bytes:
    if file[:4] != b"RIFF" or file[8:16] != b"WAVEfmt " or file[36:40] != b"data":
        raise ValueError("not a file of this store")
    return file[44 : 44 + struct.unpack("<I", file[40:44])[0]]


def feature(samples: bytes) -> str:
    """Mean, root mean square about it and share of mean crossings, of the samples that were read back."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    n, total = len(x), int(x.sum())
    above = x * n > total
    return f"mean={total / n:.6f};rms={np.sqrt(max(0.0, int((x * x).sum()) / n - (total / n) ** 2)):.6f};crossings={int((above[1:] != above[:-1]).sum()) / n:.6f}"


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:16]


def chunks(text: bytes | None) -> list[tuple[bytes, bytes]]:
    file = wav(payload(text))
    ends = cuts(file)
    return [((d := digest_of(c := file[a:b])), c) for a, b in zip([0, *ends], ends)]


def may_be_shared(digests: DataFrame) -> np.ndarray:
    """Bitmap of the digests that come more than once; its size is fixed, a full one only sends more chunks the longer way."""
    many = digests.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1")
    spot = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long") % (1 << BITS)
    words = many.select(spot.alias("spot")).selectExpr(f"cast(spot div {_WORD} as int) as word", f"shiftleft(1, cast(spot % {_WORD} as int)) as bit").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros((1 << BITS) // _WORD + 1, np.int32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def is_set(bitmap: np.ndarray, digest: bytes) -> bool:
    spot = int.from_bytes(digest[:4], "big") % (1 << BITS)
    return bool(bitmap[spot // _WORD] >> (spot % _WORD) & 1)


PART = pa.struct([("pos", pa.int32()), ("bytes", pa.binary())])
SHARED = pa.struct([("digest", pa.binary()), ("bytes", pa.binary())])


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes two tables under path: documents (row, doc_id, n_bytes, digests, own) and shared (digest, bytes).

    A null text counts as empty; every row is stored, repeated rows too (their chunks once). Texts of any length
    are cut whole; other columns are not read; an empty table gives two empty ones. Groups of copies meet only
    as digests counted with partial sums, and a shared chunk's bytes move once for each batch that saw them.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, int] = {}
            for text in bytes_of(batch):
                for d, _ in chunks(text):
                    seen[d] = seen.get(d, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["digest", "n"])

    bitmap = docs.sparkSession.sparkContext.broadcast(may_be_shared(rows.select("text").mapInArrow(count, "digest binary, n long")))
    names = ["doc_id", "n_bytes", "digests", "own", "shared"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(PART), pa.list_(SHARED)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            out, size, sent = [], 0, set()
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch)):
                found = chunks(text)
                own, shared = [], []
                for pos, (d, c) in enumerate(found):
                    if not is_set(bits, d):
                        own.append({"pos": pos, "bytes": c})
                    elif d not in sent:
                        sent.add(d)
                        shared.append({"digest": d, "bytes": c})
                out.append((doc, len(text or b""), [d for d, _ in found], own, shared))
                size += len(text or b"")
                if size > FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    schema = "doc_id long, n_bytes long, digests array<binary>, own array<struct<pos:int,bytes:binary>>, shared array<struct<digest:binary,bytes:binary>>"
    cutting = rows.mapInArrow(cut, schema).withColumn("row", F.monotonically_increasing_id())
    cutting.write.option("compression", "zstd").parquet(f"{path}/documents")
    staged = docs.sparkSession.read.parquet(f"{path}/documents")
    staged.select(F.inline("shared")).dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/shared")


def read_store(docs: DataFrame, shared: DataFrame, with_media: bool = False) -> DataFrame:
    """The documents of a store put together again and verified: one row each with the digests of what was read.

    A chunk whose digest is not its own, or that is missing, stops the job. Documents without shared chunks are
    read where they stand; for the others every wanted digest is joined with the shared chunks (a digest that
    many documents want is a skewed join key, which Spark splits), then a document's parts meet by its row.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    if with_media:
        fields.append(("media", pa.binary()))
    names, types = [n for n, _ in fields], [t for _, t in fields]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * with_media

    def finished(doc: int | None, n: int, digests: list[bytes], parts: dict[int, bytes]) -> tuple:
        if len(parts) != len(digests) or any(digest_of(parts[i]) != d for i, d in enumerate(digests)):
            raise ValueError(f"document {doc}: chunks are missing or damaged")
        file = b"".join([parts[i] for i in range(len(digests))])
        samples = samples_of(file)
        return (doc, n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(samples), *[file] * with_media)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([finished(r["doc_id"], r["n_bytes"], r["digests"], {p["pos"]: p["bytes"] for p in r["own"]}) for r in batch.to_pylist()])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, parts, rows = None, {}, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["pos"] < 0:  # a document's own row comes before its parts
                    if head:
                        rows.append(finished(head["doc_id"], head["n_bytes"], head["digests"], parts))
                    head, parts = r, {p["pos"]: p["bytes"] for p in r["own"]}
                else:
                    parts[r["pos"]] = r["bytes"]
            yield batch_of(rows)
            rows = []
        if head:
            yield batch_of([finished(head["doc_id"], head["n_bytes"], head["digests"], parts)])

    slim = docs.select("row", "doc_id", "n_bytes", "digests", "own")
    whole = F.size("digests") == F.size("own")
    local = slim.where(whole).select("doc_id", "n_bytes", "digests", "own").mapInArrow(alone, schema)
    rest = slim.where(~whole)
    wanted = rest.select("row", F.transform("own", lambda x: x["pos"]).alias("have"), F.posexplode("digests").alias("pos", "digest")).where(~F.array_contains("have", F.col("pos"))).select("row", "pos", "digest")
    fetched = wanted.join(shared, "digest").select("row", "pos", "bytes")
    none = lambda kind: F.lit(None).cast(kind)
    heads = rest.select("row", F.lit(-1).alias("pos"), none("binary").alias("bytes"), "doc_id", "n_bytes", "digests", "own")
    parts = fetched.select("row", "pos", "bytes", none("long").alias("doc_id"), none("long").alias("n_bytes"), none("array<binary>").alias("digests"), none("array<struct<pos:int,bytes:binary>>").alias("own"))
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = heads.unionByName(parts).repartition(n, "row").sortWithinPartitions("row", "pos").mapInArrow(together, schema)
    return local.unionByName(met)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Stores every row, by default in a new folder of the shared one, and reads it back: see write_store and read_store."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_store(docs, path)
    return read_store(spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/shared"))
