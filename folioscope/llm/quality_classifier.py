"""Quality score from compressed sizes under dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled rows. A text is compressed block by block under both;
the difference of its two sizes, divided by their sum, and its share of the raw size are turned into a
probability by a logistic curve fitted on other labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bytes_of, id_and_text, spread_over

#: Bounds of what is learnt from: rows a class for each of dictionaries and curve, and bytes of a row, spread over its text.
ROWS_A_CLASS = 800
BYTES_A_ROW = 16_384
DICT_BYTES = 112_640
#: Texts are compressed in blocks of so many bytes, so that a dictionary weighs as much in a long text as in a short one.
BLOCK = 1024
LEVEL = 3
#: Part of a text by which a sample's share of a dictionary begins later than that of the sample before.
STEP = 0.6180339887


def held_out(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, is fold; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        import zstandard as z

        packers = [z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False) if d else z.ZstdCompressor(level=LEVEL) for d in (self.good, self.bad)]
        out = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            t = t or b""
            blocks = [t[k : k + BLOCK] for k in range(0, len(t), BLOCK)]
            good, bad = (sum([len(p.compress(b)) for b in blocks]) for p in packers)
            out[i] = ((bad - good) / max(1, bad + good), good / max(1, len(t)), np.log1p(len(t)))
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        x = expand((self.features(texts) - self.mean) / self.scale)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))


def expand(x: np.ndarray) -> np.ndarray:
    """The curve's inputs: 1, each feature, their squares and products."""
    n = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *[x[:, i] * x[:, j] for i in range(n) for j in range(i, n)]])


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton's method with halved steps, so that separable rows do no harm."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * b @ b)

    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge * np.eye(len(b)), x.T @ (w * (y - p)) - ridge * b)
        while loss(b + step) > loss(b) and np.abs(step).max() > 1e-9:
            step = step / 2
        b = b + step
        if np.abs(step).max() < 1e-7:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, rows_a_class: int = ROWS_A_CLASS) -> Model:
    """Fits on at most 4 * rows_a_class labelled rows, those with the smallest hashes of doc_id; null labels and texts are left out.

    Without rows of both classes every score is the share of label 1 (0.5 without any label).
    """
    labels = labels.where("quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r.quality: r.n for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = None
    for q in (0, 1):  # at most 2 * rows_a_class ids a class: bounded, so they may be broadcast
        part = labels.where(F.col("quality") == q).select("doc_id", "quality", F.xxhash64("doc_id").alias("h")).orderBy(*order).limit(2 * rows_a_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = id_and_text(docs).where("text is not null").join(F.broadcast(chosen), "doc_id").groupBy("h", "doc_id", "quality").agg(F.min(spread_over(F.col("text").cast("binary"), BYTES_A_ROW)).alias("b"))
    rows = sorted(texts.collect(), key=lambda r: (r.quality, r.h, r.doc_id))  # of repeated ids one row
    by = {q: [bytes(r.b) for r in rows if r.quality == q] for q in (0, 1)}
    total = sum(counts.values())
    model = Model(b"", b"", [0.0] * 3, [1.0] * 3, [0.0] * 10)
    if min(map(len, by.values())) < 4:
        share = (counts.get(1, 0) + 1) / (total + 2)
        model.weights[0] = float(np.log(share / (1 - share)))
        return model
    first, rest = ({q: v[k::2] for q, v in by.items()} for k in (0, 1))
    model.good, model.bad = dictionary(first[1]), dictionary(first[0])
    x = model.features(rest[0] + rest[1])
    y = np.array([0.0] * len(rest[0]) + [1.0] * len(rest[1]))
    w = np.where(y == 1, counts[1] / total / len(rest[1]), counts[0] / total / len(rest[0])) * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    model.mean, model.scale = mean.tolist(), scale.tolist()
    model.weights = fit_logistic(expand((x - mean) / scale), y, w).tolist()
    return model


def dictionary(samples: list[bytes], most: int = DICT_BYTES) -> bytes:
    """The content of a dictionary: an equal share of every sample, from another part of each, so that all parts of texts have their say."""
    share = max(64, most // len(samples))
    starts = [int(max(0, len(s) - share) * (k * STEP % 1)) for k, s in enumerate(samples)]
    return b"".join([s[a : a + share] for s, a in zip(samples, starts)])[:most]


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every row.

    Equal texts have equal scores, and a score of the very threshold counts as above it. Null and empty texts are scored as texts of no bytes; texts are compressed whole; repeated rows get equal
    scores; other columns are not read. The model (two dictionaries of at most DICT_BYTES) goes with the tasks.
    """
    packed = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = packed.value.scores(bytes_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double, predicted int")
