"""License scan with a positional index of licence texts.

Every word of a template's key phrases has postings: the templates it stands in, and its position there. A file's licence words
are looked up from the highest inverse document frequency (over all documents) down. A word's place in the file minus its
position is where the template would begin; the next words' postings leave those begins at which they stand, too, LOOKUPS
words of a template at most. What is left is verified by the key phrases, which must stand at their positions, and by the weight
of the template's words in place. Every template whose key words are all in the file is tried at each of its begins.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import bytes_of, id_and_text

#: Phrases counted everywhere, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, notice, key phrases that must stand at their places (words as the scan takes them).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "associated documentation files"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice", "substantial portions of the software"]),
    ("mit", "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["merge publish distribute sublicense"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("apache-2.0", "apache license version 2 0 january 2004", ["apache license version 2 0"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("lgpl", "gnu library general public license", ["library general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("agpl", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "following conditions are met"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", ["redistributions in binary form must reproduce"]),
    ("bsd", "may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products derived from this software"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at", ["copy of the mpl was not distributed"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc0", "dedicated to the public domain under the cc0 1 0 universal public domain dedication", ["cc0 1 0 universal"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary", ["anyone is free to copy modify publish use compile sell"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("reserved", "copyright all rights reserved", ["all rights reserved"]),
    ("mit", "mit license", ["mit license"]),
    ("mpl-2.0", "mozilla public license 2 0", ["mozilla public license 2 0"]),
    ("mpl-2.0", "mozilla public license version 2 0", ["mozilla public license version 2 0"]),
    ("epl", "eclipse public license", ["eclipse public license"]),
    ("bsl-1.0", "boost software license version 1 0", ["boost software license"]),
]

#: Label and how the words of a licence identifier begin; the longest that fits counts.
IDENTIFIERS = [("mit", "mit"), ("apache-2.0", "apache 2 0"), ("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("bsd", "bsd"), ("isc", "isc"), ("mpl-2.0", "mpl 2 0"), ("cc-by-nc", "cc by nc"), ("cc-by-sa", "cc by sa"), ("cc-by", "cc by 4 0"), ("cc-by", "cc by 3 0"), ("cc0", "cc0 1 0"), ("unlicense", "unlicense"), ("epl", "epl"), ("bsl-1.0", "bsl 1 0")]
#: What an identifier line begins with; what may follow an identifier; what joins two.
IDENTIFIER_LINE, VERSIONS, JOINTS = "spdx license identifier", re.compile(rb"[0-9]+|only|plus|clause|later"), (b"or", b"and")

#: Digits, letters in lower case and all bytes of other characters; the rest are spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a template that are looked up at most; words that must agree on a beginning, least share of weight found.
LOOKUPS, AGREE, LEAST_SHARE = 3, 2, 0.5


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]  # (position, words), one at least


def templates(source=TEMPLATES) -> list[Template]:
    out = []
    for label, text, keys in source:
        words = text.encode().split()
        placed = []
        for k in keys:
            k = k.encode().split()
            placed.append((next(i for i in range(len(words)) if words[i : i + len(k)] == k), k))
        out.append(Template(label, words, placed))
    return out


class Index:
    """Postings of the templates, weighted by document frequencies over n documents."""

    def __init__(self, df: dict[bytes, int], n: int, source=TEMPLATES, base=BASE):
        self.templates = templates(source)
        self.base = [(p.encode().split(), label) for p, label in base.items()]
        self.line = IDENTIFIER_LINE.encode().split()
        self.vocabulary = frozenset(w for x in self.templates for w in x.words) | {w for p, _ in self.base for w in p} | frozenset(self.line)
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-6 for w in self.vocabulary}
        self.weight = [sum(self.idf[w] for w in x.words) for x in self.templates]
        self.needs = [frozenset(w for _, k in x.keys for w in k) for x in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)  # of words of key phrases: template, position
        for t, x in enumerate(self.templates):
            for position, w in sorted({(i + j, w) for i, k in x.keys for j, w in enumerate(k)}):
                self.postings[w].append((t, position))
        # the licence words from the rarest on, ties by the word
        self.order = {w: k for k, w in enumerate(sorted(self.postings, key=lambda w: (-self.idf[w], w)))}
        self.identifiers = sorted(((label, name.encode().split()) for label, name in IDENTIFIERS), key=lambda x: -len(x[1]))

    def begins(self, words: list[bytes], present: frozenset[bytes], at: dict[bytes, list[int]]) -> dict[int, list[int]]:
        """Where each template may begin, by the file's licence words from the rarest on."""
        tried = {t for t, needs in enumerate(self.needs) if present.issuperset(needs)}
        found: dict[int, list[int]] = {}
        used: Counter = Counter()
        for w in sorted(present.intersection(self.order), key=self.order.__getitem__) if tried else ():
            for t, position in self.postings[w]:
                if t not in tried or used[t] >= LOOKUPS:
                    continue
                used[t] += 1
                if t in found:
                    found[t] = [b for b in found[t] if 0 <= b + position < len(words) and words[b + position] == w]
                else:
                    found[t] = [place - position for place in at[w]]
                if not found[t]:
                    tried.discard(t)
        return found

    def identified(self, words: list[bytes], at: dict[bytes, list[int]]) -> set[str]:
        """Labels of all licences in the expressions of identifier lines."""
        labels: set[str] = set()
        for i in at.get(self.line[0], ()):
            if words[i : i + len(self.line)] != self.line:
                continue
            i += len(self.line)
            while True:
                name = next(((label, k) for label, k in self.identifiers if words[i : i + len(k)] == k), None)
                if name is None:
                    break
                labels.add(name[0])
                i += len(name[1])
                while i < len(words) and (VERSIONS.fullmatch(words[i]) or words[i : i + 2] == [b"or", b"later"]):
                    i += 1
                if words[i : i + 1] == [b"with"]:  # an exception, of a few words
                    i = next((k for k in range(i, min(i + 6, len(words))) if words[k] in JOINTS), len(words))
                if i >= len(words) or words[i] not in JOINTS:
                    break
                i += 1
        return labels

    def scan(self, words: list[bytes]) -> tuple[int, int | None, int | None, str, str, float]:
        """n_base, first_word, last_word, base_labels, labels, score."""
        present = self.vocabulary.intersection(words)
        if not present:
            return 0, None, None, "", "", 0.0
        starts: list[int] = []
        base: set[str] = set()
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)
        for phrase, label in self.base:
            if present.issuperset(phrase):
                rare = min(range(len(phrase)), key=lambda k: len(at[phrase[k]]))
                found = [i - rare for i in at[phrase[rare]] if i >= rare and words[i - rare : i - rare + len(phrase)] == phrase]
                if found:
                    starts += found
                    base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        named = self.identified(words, at) if present.issuperset(self.line) else set()
        if named:
            labels, score = labels | named, 1.0
        for t, places in self.begins(words, present, at).items():
            x = self.templates[t]
            for begin in places:
                if any(begin + i < 0 or words[begin + i : begin + i + len(k)] != k for i, k in x.keys):
                    continue
                there = [self.idf[w] for i, w in enumerate(x.words) if 0 <= begin + i < len(words) and words[begin + i] == w]
                share = sum(there) / self.weight[t]
                if len(there) < AGREE or share < LEAST_SHARE:
                    continue
                labels.add(x.label)
                score = max(score, min(1.0, share))
        return len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> tuple[dict[bytes, int], int]:
    """How many of all documents hold each word of the vocabulary; what comes to the driver is bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        n = 0
        for batch in batches:
            for text in bytes_of(batch):
                n += 1
                count.update(vocabulary.intersection(words_of(text)))
        rows = [*count.items(), (b"", n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64())], ["w", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r.w): r.n for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, source=TEMPLATES, base=BASE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null texts count as empty: no words, null first_word and last_word, empty labels, score 0. The score is the
    largest share, by weight, of a verified template's words that stand in place; 1 where a base phrase stands.
    Texts are scanned whole, of any length; repeated rows give equal rows; words of one frequency are looked up in order of the
    word, which the result does not depend on; an empty table gives an empty result; other columns are not read. Two passes
    over the texts, no shuffle of texts; the index is a fixed list of notices.
    """
    vocabulary = Index({}, 0, source, base).vocabulary
    df, n = document_frequencies(docs, vocabulary)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n, source, base)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch)):
                words = words_of(text)
                rows.append((doc, len(words), *index.scan(words)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)

    return id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
