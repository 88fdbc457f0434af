import hashlib
import random
import re
import zlib

import numpy as np

from folioscope.llm import license_scan, media

ROWS = [(1, "plain text"), (2, None), (3, ""), (4, "x" * 40_000), (5, "é漢" * 3000), (6, "plain text"), (6, "plain text"), (None, "no id"), (7, "".join(chr(97 + i * i % 23) for i in range(60_000))), (8, "".join(chr(97 + i * i % 23) for i in range(50_000))), (9, " " * 192)]


def test_cuts_follow_content():
    rnd = random.Random(3)
    a = bytes(rnd.randrange(256) for _ in range(200_000))
    ends = media.cuts(a)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(a) and sizes.max() <= media.MOST and sizes[:-1].min() >= media.LEAST
    b = b"inserted" + a
    moved = media.cuts(b)
    same = {a[x:y] for x, y in zip([0, *ends], ends)} & {b[x:y] for x, y in zip([0, *moved], moved)}
    assert sum(map(len, same)) > 0.9 * len(a)
    for i in rnd.sample(range(31, len(a)), 200):  # the vector form equals the rolling one
        h = 0
        for x in a[i - 31 : i + 1]:
            h = (h << 1) + int(media.GEAR[x]) & 0xFFFFFFFF
        v = media.GEAR[np.frombuffer(a[i - 31 : i + 1], np.uint8)]
        assert h == sum(int(x) << (31 - k) for k, x in enumerate(v)) & 0xFFFFFFFF


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 5, "k") for i, t in ROWS], "doc_id long, text string, row int, digests string")
    got = media.round_trip(docs.repartition(3)).collect()
    assert len(got) == len(ROWS)
    for i, t in ROWS:
        p = media.payload((t or "").encode())
        assert len(p) % 192 == 0 and len(p) > 0
        r = next(r for r in got if r.doc_id == i)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(media.wav(p)), hashlib.sha256(media.wav(p)).hexdigest(), media.feature(p))
    assert media.round_trip(docs.limit(0)).count() == 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    media.write_store(docs, f"file://{tmp_path}/store")
    d, s = (spark.read.parquet(f"file://{tmp_path}/store/{x}") for x in ("documents", "shared"))
    assert s.count() == s.select("digest").distinct().count() > 0
    assert media.read_store(d, s, with_media=True).count() == len(ROWS)
    for broken in (s.limit(0), s.selectExpr("digest", "concat(bytes, X'00') as bytes")):
        try:
            media.read_store(d, broken).collect()
            raise SystemExit("not found")
        except Exception as e:  # noqa: BLE001
            assert "missing or damaged" in str(e)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_scan(spark):
    texts = [None, "", "All rights reserved.", "CC BY CC-BY cc by", "é general public license x GENERAL  PUBLIC\nLICENSE", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License. " * 50, "cc", "by cc", "İcc by", "Licensed under CC BY-NC 4.0. " + "w " * 5000, "license mit the under released"]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, labels string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(t)
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert got[5].labels == "apache-2.0" and got[6].labels == "mit" and got[10].labels == "cc-by,cc-by-nc" and got[11].labels == ""
    assert license_scan.scan(docs.limit(0)).count() == 0
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in real.collect()}
    for r in license_scan.scan(real).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text[r.doc_id])


def test_several_notices_in_one_file():
    real = {b"the": 900, b"of": 800, b"to": 700, b"by": 300, b"in": 300, b"and": 600, b"license": 60, b"licensed": 50, b"cc": 40, b"mit": 30}
    index = license_scan.Index(real, 1000)
    notice = {label: text for label, text, _ in license_scan.TEMPLATES[::-1]}
    notice["mit long"] = next(t for _, t, _ in license_scan.TEMPLATES if t.startswith("permission is hereby granted"))
    notice["bsd"] = next(t for _, t, _ in license_scan.TEMPLATES if t.startswith("redistribution and use"))
    for a, b in (("mit long", "cc-by-nc"), ("bsd", "mit"), ("gpl", "isc")):
        got = index.scan(license_scan.words_of(f"{notice[a]} some words between {notice[b]}".encode()))[4]
        assert {a.split()[0], b} <= set(got.split(",")), (a, b, got)
    every = " x ".join(text for _, text, _ in license_scan.TEMPLATES)
    assert set(index.scan(license_scan.words_of(every.encode()))[4].split(",")) == {label for label, _, _ in license_scan.TEMPLATES}


def plain_identifiers(text):
    """Labels of the licences that expressions of identifier lines name, by one pattern."""
    names = "|".join(sorted((name for _, name in license_scan.IDENTIFIERS), key=lambda x: (-len(x.split()), x)))
    one = rf"(?:{names})(?: (?:[0-9]+|only|plus|clause|later)(?= )| or(?= later ))*"
    out = set()
    for m in re.finditer(rf"(?= spdx license identifier ((?:{one})(?:(?: with(?: (?!or |and )[^ ]+){{0,4}})? (?:or|and) {one})*) )", f" {text} "):
        for x in re.split(" (?:or|and) (?!later)", m.group(1)):
            out.add(next(label for label, name in sorted(license_scan.IDENTIFIERS, key=lambda y: -len(y[1].split())) if f"{x} ".startswith(f"{name} ")))
    return out


def plain_labels(index, words):
    """Labels and score from every template at every place of a text, without an index."""
    base = {label for phrase, label in license_scan.BASE.items() if f" {phrase} " in f" {b' '.join(words).decode()} "}
    named = plain_identifiers(" ".join(w.decode() for w in words))
    labels, score = base | named, 1.0 if base | named else 0.0
    for label, notice, keys in license_scan.TEMPLATES:
        notice = notice.encode().split()
        weights = [index.idf[w] for w in notice]
        for begin in range(-len(notice), len(words)):
            at = [words[begin + i] if 0 <= begin + i < len(words) else None for i in range(len(notice))]
            joined = lambda ws: " " + " ".join("?" if w is None else w.decode() for w in ws) + " "
            places = [joined(notice[:i] + [b"<"]).split().index("<") for i in range(len(notice))]
            ok = True
            for key in keys:
                key = key.encode().split()
                i = next(i for i in places if notice[i : i + len(key)] == key)
                ok = ok and at[i : i + len(key)] == key
            there = [w for x, y, w in zip(notice, at, weights) if x == y]
            if ok and len(there) >= license_scan.AGREE and sum(there) / sum(weights) >= license_scan.LEAST_SHARE:
                labels.add(label)
                score = max(score, min(1.0, sum(there) / sum(weights)))
    return ",".join(sorted(labels)), score


def test_labels_and_score_against_every_place():
    rnd = random.Random(12)
    vocabulary = sorted(license_scan.Index({}, 0).vocabulary)
    index = license_scan.Index({w: rnd.randrange(1, 900) for w in vocabulary}, 1000)
    seen = set()
    for n in range(1, 15):
        words = []
        for _, notice, _ in rnd.sample(license_scan.TEMPLATES, n):
            notice = notice.encode().split()
            if rnd.random() < 0.5:  # damaged: words lost at an end, or one word changed
                notice = notice[rnd.randrange(3) :] if rnd.random() < 0.5 else [*notice[:-1], b"x"]
            words += [*rnd.choices(vocabulary, k=rnd.randrange(4)), *notice]
        labels, score = index.scan(words)[4:]
        want = plain_labels(index, words)
        assert labels == want[0] and abs(score - want[1]) < 1e-9
        seen.update(labels.split(","))
    assert len(seen) > 12


def test_several_notices_names_and_identifier_lines():
    index = license_scan.Index({}, 1000)
    labels = lambda text: index.scan(license_scan.words_of(text.encode()))[4]
    assert labels("GNU Lesser General Public License v3") == "gpl,lgpl"
    assert labels("// SPDX-License-Identifier: MPL-2.0") == "mpl-2.0" and labels("# SPDX-License-Identifier: GPL-3.0-or-later") == "gpl"
    assert labels("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.") == "mit"
    assert labels("MIT License\n\nCopyright") == "mit" and labels("Mozilla Public License 2.0") == "mpl-2.0" and labels("Eclipse Public License - v 2.0") == "epl" and labels("Boost Software License, Version 1.0") == "bsl-1.0"
    assert labels("SPDX-License-Identifier: (MIT OR Apache-2.0)") == "apache-2.0,mit" and labels("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND BSD-3-Clause") == "bsd,gpl"
    assert labels("SPDX-License-Identifier: EPL-2.0 OR (GPL-2.0-only AND ISC) x MIT") == "epl,gpl,isc" and labels("SPDX-License-Identifier: MIT or so") == "mit" and labels("SPDX license identifier") == ""
    tied = license_scan.Index({w: 5 for w in license_scan.Index({}, 0).vocabulary}, 10)  # all words alike
    assert tied.scan(license_scan.words_of(b"released under the mit license"))[4] == "mit"
    assert labels("License: MIT-like words, spdx identifier license mit") == ""
    one = license_scan.Index({}, 10, base={"copyleft": "copyleft"})
    assert one.scan([b"copyleft"])[:5] == (1, 0, 0, "copyleft", "copyleft")
    long = "w " * 300_000 + "Released under the MIT License. " + "MIT license " * 20_000
    assert labels(long) == "mit"
