"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged across, so it marks a certain
cut. Every pre-token is split at such pairs, the fragments are encoded each for itself (fragments are
kept in a bounded cache) and concatenated. Only the last fragment of a pre-token carries the end-of-word
suffix.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import Bounded, id_and_text, texts_of

#: Below this code point lower case and canonical forms are the same in every Unicode version.
PLAIN_BELOW = "ɐ"
#: White space by Unicode's property; unlike Python's, without U+001C to U+001F.
WHITE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def default_file() -> str:
    import public_tokenizers as p

    return p.path("word_bpe_49k.json")


class Fragments(Bounded):
    """Ids of (fragment, is it the last of its pre-token)."""

    def __init__(self, spec: dict, most: int):
        super().__init__(most)
        from tokenizers import models

        vocab, merges = spec["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.suffix = spec.get("end_of_word_suffix") or ""
        self.models = {last: models.BPE(vocab=vocab, merges=merges, **({"end_of_word_suffix": self.suffix} if last and self.suffix else {})) for last in (True, False)}
        inside = {t.removesuffix(self.suffix) if self.suffix else t for t in vocab}
        self.joinable = {t[i : i + 2] for t in inside for i in range(len(t) - 1)}

    def make(self, key: tuple[str, bool]) -> list[int]:
        return [t.id for t in self.models[key[1]].tokenize(key[0])]

    def split(self, word: str) -> list[str]:
        """word, in the alphabet of bytes, cut at every pair that no token holds inside."""
        joinable = self.joinable
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in joinable]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])] if cuts else [word]


class Codec(Bounded):
    """(ids in decimal, decoded text, number of ids) of a space-separated unit."""

    def __init__(self, json_path: str, most: int = 300_000):
        super().__init__(most)
        import regex
        from tokenizers import Tokenizer

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.full = Tokenizer.from_file(json_path)
        self.fragments = Fragments(spec["model"], most)
        self.token = {i: t for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", WHITE))
        # the usual printable alphabet of the 256 bytes
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.alphabet = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def pretokens(self, unit: str) -> list[str]:
        if max(unit, default="") < PLAIN_BELOW:
            found = self.words.findall(unicodedata.normalize("NFC", unit).lower())
            return [w if w.isascii() and w.isprintable() else "".join([self.alphabet[b] for b in w.encode()]) for w in found]
        return [w for w, _ in self.full.pre_tokenizer.pre_tokenize_str(self.full.normalizer.normalize_str(unit))]

    def encode_unit(self, unit: str) -> list[int]:
        ids: list[int] = []
        for word in self.pretokens(unit):
            parts = self.fragments.split(word)
            for part in parts[:-1]:
                ids += self.fragments[part, False]
            ids += self.fragments[parts[-1], True]
        return ids

    def make(self, unit: str) -> tuple[str, str, int]:
        ids = self.encode_unit(unit)
        return " ".join(map(str, ids)), " ".join([self.token[i] for i in ids]), len(ids)

    def units(self, text: str) -> list[tuple[str, str, int]]:
        """What make() gives for the units that have ids, in order.

        A space ends a pre-token and takes no part in canonical composition, so units are independent.
        """
        out = []
        for part in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if part in self.special:
                out.append((str(self.special[part]), part, 1))
            else:
                out += [u for u in map(self.__getitem__, part.split(" ")) if u[2]]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for u in self.units(text) for i in u[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids])


def encode_decode(docs: DataFrame, json_path: str | None = None, with_values: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row (and ids, decoded).

    Null texts count as empty: no ids, empty decoded text. White space alone has no ids. Very long texts
    are worked through unit by unit; repeated rows give equal rows; other columns are not read. One pass,
    no shuffle.
    """
    json_path = json_path or default_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(json_path)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for batch in batches:
            n, ids, back, values = [], [], [], []
            for text in texts_of(batch):
                units = codec.units(text or "")
                n.append(sum([u[2] for u in units]))
                ids.append(sha([u[0] for u in units]))
                back.append(sha([u[1] for u in units]))
                if with_values:
                    values.append(([int(i) for u in units for i in u[0].split(" ")], " ".join([u[1] for u in units])))
            cols, names = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_values:
                cols += [pa.array([v[0] for v in values], pa.list_(pa.int64())), pa.array([v[1] for v in values], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_values
    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)
