"""Language of a text from unigram piece probabilities, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The forward algorithm sums,
over all ways to cut a word into pieces, the product of their probabilities; a text's likelihood is the
product over its words, as no piece crosses a word's start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import bytes_of, id_and_text, spread_over

#: Bounds of what is learnt from: rows a language, bytes of a row, spread over its text, different words a language.
ROWS_A_LANG = 250
BYTES_A_ROW = 8192
WORDS_A_LANG = 12_000
START = "▁"
#: ASCII: letters in lower case, all else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LONG = 64


def vocabulary(path: str | None = None) -> list[str]:
    import sentencepiece as sp

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sp.SentencePieceProcessor(model_file=path)
    found = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
    return sorted({p for p in found if START not in p[1:]})


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def as_pieces(word: bytes) -> str:
    return START + word.decode("utf-8", "replace").lower()


@dataclass
class Model:
    langs: list[str]
    pieces: list[str]
    probs: np.ndarray  # a row for each piece after row 0, which is 0; a column for each language
    unknown: float

    def trie(self) -> dict:
        """Character to [row of the piece that ends there or 0, trie of what may follow]."""
        root: dict = {}
        for k, piece in enumerate(self.pieces):
            at = root
            for c in piece[:-1]:
                at = at.setdefault(c, [0, {}])[1]
            at.setdefault(piece[-1], [0, {}])[0] = k + 1
        return root

    def forward(self, words: list[str]) -> np.ndarray:
        """Logarithm of the sum over all segmentations of each word, for each language; a character may also stand as unknown."""
        out = np.zeros((len(words), len(self.langs)))
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, at in by.items():
            step = max(1, FORWARD // n)
            for k in range(0, len(at), step):
                part = at[k : k + step]
                out[part] = self._forward(n, [words[i] for i in part])
        return out

    def _forward(self, n: int, words: list[str]) -> np.ndarray:
        if not hasattr(self, "_trie"):
            self._trie = self.trie()
        root, count = self._trie, len(words)
        wide = max(map(len, self.pieces), default=0) + 1
        found: list = [None] * (n * wide + wide)  # at start * wide + length: words with a piece there, its rows
        for k, word in enumerate(words):
            for i in range(n):
                at, place = root, i * wide
                for c in word[i : i + wide - 1]:
                    place += 1
                    step = at.get(c)
                    if step is None:
                        break
                    row, at = step
                    if row:
                        hit = found[place]
                        if hit is None:
                            found[place] = [k], [row]
                        else:
                            hit[0].append(k)
                            hit[1].append(row)
        places = {(p // wide, p // wide + p % wide): x for p, x in enumerate(found) if x}
        ends: dict[int, list[int]] = {}
        for i, j in places:
            ends.setdefault(i, []).append(j)
        sums: dict[int, np.ndarray] = {0: np.ones((count, len(self.langs)))}
        shift = np.zeros((count, 1))
        for i in range(n):
            a = sums.pop(i)
            if i % 16 == 15:  # against underflow: the sums that are open are scaled together
                top = np.maximum(a.max(1, keepdims=True), 1e-300)
                a = a / top
                for j in sums:
                    sums[j] = sums[j] / top
                shift += np.log(top)
            sums[i + 1] = sums.get(i + 1, 0.0) + a * self.unknown
            for j in ends.get(i, ()):
                k, p = places[i, j]
                if j not in sums:
                    sums[j] = np.zeros_like(a)
                sums[j][k] += a[k] * self.probs[p]
        return np.log(np.maximum(sums[n], 1e-300)) + shift


#: Characters of words that are summed at a time; bytes of texts scored at a time; bytes of words kept.
FORWARD, SCORED, KEPT = 40_000, 2 << 20, 64 << 20


class Scorer:
    """Log-likelihoods of texts; those of words are kept in a table of bounded size."""

    def __init__(self, model: Model, most: int = 1_000_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.held, self.rows = 0, np.zeros((1024, len(self.model.langs)))

    def put(self, words: set[bytes]) -> None:
        if len(self.at) + len(words) > self.most or self.held > KEPT:
            self.clear()
        new = sorted(words.difference(self.at))
        k = len(self.at)
        while k + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k : k + len(new)] = self.model.forward([as_pieces(w) for w in new])
        self.at.update(zip(new, range(k, k + len(new))))
        self.held += sum(map(len, new))

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Texts are taken a few megabytes at a time."""
        k = 0
        while k < len(texts):
            size, part = 0, []
            while k < len(texts) and (not part or size + len(texts[k]) <= SCORED):
                part.append(words_of(texts[k]))
                size += len(texts[k])
                k += 1
            words: set[bytes] = set()
            for ws in part:
                words.update(ws)
            if not words.issubset(self.at):
                self.put(words.difference(self.at) if len(self.at) + len(words) <= self.most and self.held <= KEPT else words)
            for ws in part:
                yield self.rows[list(map(self.at.__getitem__, ws))].sum(0)


def expected(words: Counter, probs: dict[str, float], longest: int) -> Counter:
    """Expected uses of each piece over all segmentations of the words (forward and backward sums)."""
    out: Counter = Counter()
    for word, times in words.items():
        n = len(word)
        edges = [(i, j, word[i:j], p) for j in range(1, n + 1) for i in range(max(0, j - longest), j) if (p := probs.get(word[i:j]))]
        f, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for i, j, _, p in edges:  # by rising end
            f[j] += f[i] * p
        if f[n] <= 0:
            continue
        for i, j, _, p in reversed(edges):
            b[i] += b[j] * p
        for i, j, piece, p in edges:
            if u := f[i] * p * b[j]:
                out[piece] += times * u / f[n]
    return out


def train(docs: DataFrame, path: str | None = None, rows_a_lang: int = ROWS_A_LANG, rounds: int = 2) -> Model:
    """Fits on at most rows_a_lang rows of each language, those with the smallest hashes of doc_id, by expectation maximisation.

    docs has doc_id, text and lang; rows with null text or lang are left out. Without rows the model has no language.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("doc_id").alias("h"))
    # first by a hash bucket of a language, so that no language meets in one task
    near = W.partitionBy("lang", F.pmod(F.col("h"), F.lit(64))).orderBy("h", "doc_id")
    far = W.partitionBy("lang").orderBy("h", "doc_id")
    ids = rows.withColumn("r", F.row_number().over(near)).where(F.col("r") <= rows_a_lang).withColumn("r", F.row_number().over(far)).where(F.col("r") <= rows_a_lang)
    got = ids.select("doc_id", "lang", "h").collect()
    wanted = docs.sparkSession.createDataFrame([(r.doc_id, r.lang) for r in got], "doc_id long, lang string")
    sample = docs.where("text is not null").select("doc_id", "lang", spread_over(F.col("text").cast("binary"), BYTES_A_ROW).alias("b")).join(F.broadcast(wanted), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("b").alias("b")).collect()  # of repeated ids one row
    langs = sorted({r.lang for r in sample})
    pieces = vocabulary(path)
    longest = min(16, max(map(len, pieces), default=1))
    pieces = [p for p in pieces if len(p) <= longest]
    table = {}
    for lang in langs:
        count = Counter(as_pieces(w) for r in sample if r.lang == lang for w in words_of(bytes(r.b)) if len(w) <= LONG)
        words = Counter(dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:WORDS_A_LANG]))
        # the first round's probabilities fall with a piece's length alone
        probs = {p: 0.05 ** max(1, len(p) - 1) for p in pieces}
        for _ in range(rounds):
            uses = expected(words, probs, longest)
            whole = sum(uses.values()) + 0.01 * len(pieces)
            probs = {p: (uses.get(p, 0.0) + 0.01) / whole for p in pieces}
        table[lang] = probs
    return Model(langs, pieces, np.array([[0.0] * len(langs), *[[table[x][p] for x in langs] for p in pieces]]), 1e-9)


def predict(docs: DataFrame, model: Model, none: str = "und") -> DataFrame:
    """doc_id, lang_pred and score (the likeliest language's share of the likelihood) of every row.

    Null texts and texts without a letter get `none` and 0; so do all without a learnt language. Ties go to the
    language that sorts first. Texts are read whole; a word of any length is summed without being kept; repeated
    rows get equal results; other columns are not read. The model's size is bounded by vocabulary times languages.
    """
    slim = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return with_prediction(slim, model, "lang_pred", "score", none).drop("text")


def with_prediction(docs: DataFrame, model: Model, pred: str, score: str, none: str = "und") -> DataFrame:
    """docs with two more columns, named pred and score: see predict."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, langs = Scorer(shared.value), shared.value.langs
        for batch in batches:
            texts = bytes_of(batch)
            real = [i for i, t in enumerate(texts) if langs and t and has_letter(t)]
            names, scores = [none] * len(texts), [0.0] * len(texts)
            for i, x in zip(real, scorer([texts[i] for i in real])):
                k = int(x.argmax())
                names[i] = langs[k]
                scores[i] = float(1 / np.exp(np.clip(x - x[k], -700, 0)).sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, pred, score])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


_ASCII_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def has_letter(text: bytes) -> bool:
    head = text[:256]
    if len(head.translate(None, _ASCII_LETTERS)) < len(head) or len(text.translate(None, _ASCII_LETTERS)) < len(text):
        return True
    return any(map(str.isalpha, text.decode("utf-8", "replace")))
