"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are put in a seeded random order and ranked; the rank divided by the source's size is
a row's fractional rank. Ordered by it, all sources advance in step, so any contiguous cut has the mixture
of the whole. The order is cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.llm.common import checkpointed, fresh_name

#: Ranks are counted inside hash buckets of about so many rows, on top of each bucket's offset.
BUCKET_ROWS = 2048
LEAST_BITS, MOST_BITS = 8, 16


def assign_shards(rows: DataFrame, n_shards: int, stratum: str = "source", key: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 20) -> DataFrame:
    """rows with shard (0 to n_shards - 1) and slot (0 on, without gaps, in each shard).

    Every row gets a place, repeated rows too; rows alike in key and ties may swap places. A null source is a
    source of its own; null keys are ordered first. An empty table gives an empty result. Columns of rows keep
    their names; if shard or slot is among them, the new one gets underscores. `rows` should hold few columns: it is
    shuffled twice. Texts play no part, so their length does not matter.

    No source meets in one task: a row's rank is its place in a (source, hash bucket) group plus the sizes of
    the buckets before; the second order is counted likewise in buckets of the fractional rank.
    """
    names = [fresh_name(rows, "shard"), fresh_name(rows, "slot")]
    total = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, total / BUCKET_ROWS)))))
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("body")
    h = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in (key, *ties)])  # null keys alone would share one hash
    name = F.col(f"`{stratum}`").cast("string")
    keyed = rows.select(body, F.when(name.isNull(), "-").otherwise(F.concat(F.lit("+"), name)).alias("s"), h.alias("h"), F.shiftrightunsigned(h, 64 - bits).alias("b"))

    sizes = keyed.groupBy("s", "b").agg(F.count("*").alias("n"))
    before = W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("s", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"), F.sum("n").over(W.partitionBy("s")).alias("ns"))
    inside = W.partitionBy("s", "b").orderBy("h", *[F.col(f"body.`{c}`") for c in (key, *ties)])
    phase = (F.pmod(F.xxhash64(F.lit(seed), F.col("s")), F.lit(1 << 20)) + 0.5) / float(1 << 20)
    ranked = keyed.join(offsets, ["s", "b"]).select("body", "s", (F.col("off") + F.row_number().over(inside)).alias("r"), "ns")
    # a phase of its own for each source keeps small sources from meeting at the same fractions
    ranked = ranked.select("body", "s", "r", ((F.col("r") - phase) / F.col("ns")).alias("f"))
    ranked = checkpointed(ranked.withColumn("g", F.floor(F.col("f") * (1 << bits)).cast("long")))

    steps = ranked.groupBy("g").agg(F.count("*").alias("n"))  # at most 2 ** MOST_BITS rows
    starts = steps.select("g", F.coalesce(F.sum("n").over(W.orderBy("g").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    place = F.col("off") + F.row_number().over(W.partitionBy("g").orderBy("f", "s", "r")) - 1
    placed = ranked.join(F.broadcast(starts), "g").select("body", place.alias("p"))
    shard = F.expr(f"p * {n_shards} div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    start = F.expr(f"(shard * cast({total} as bigint) + {n_shards - 1}) div {n_shards}")
    return placed.select("body.*", F.col("shard").alias(names[0]), (F.col("p") - start).alias(names[1]))


def text_rows(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (UTF-8 bytes and 8) and text_crc32: what sharding needs of a document; a null text has no bytes."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    )
