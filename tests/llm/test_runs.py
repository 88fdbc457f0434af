import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from folioscope.llm import periodic_runs, queries
from folioscope.llm.periodic_runs import Catchers, find_runs, runs_of


def brute(t, least=24, times=3):
    """All runs by their definition."""
    out, n = set(), len(t)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(t[x] == t[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.add((i, length, q))
            i = j
    return sorted(out)


def samples():
    rnd = random.Random(5)
    yield []
    yield [1] * 23
    yield [1] * 24
    yield [1] * 400
    yield list(range(300))
    for q in range(1, 60):
        period = [rnd.randrange(5) for _ in range(q)]
        yield ([9] * rnd.randrange(9) + period * (3 + rnd.randrange(4)) + period[: rnd.randrange(q)] + [8] * rnd.randrange(9))[:500]
    for _ in range(60):
        t = [rnd.randrange(2) for _ in range(rnd.randrange(30))]
        while len(t) < 300:
            a = rnd.randrange(len(t) + 1)
            t += t[a : a + rnd.randrange(1, 40)] * rnd.choice([1, 1, 2, 3, 5, 9]) or [rnd.randrange(3)]
        yield t


def test_catchers_find_all_runs():
    for t in samples():
        want = brute(t)
        whole = Catchers(len(t))
        whole.append(np.array(t, np.int64))
        assert whole.runs() == want
        pieces, at = Catchers(len(t)), 0
        for k in random.Random(len(t)).choices(range(1, 50), k=600):  # appended in any pieces
            pieces.append(np.array(t[at : at + k], np.int64))
            at += k
            if at >= len(t):
                break
        assert pieces.runs() == want


def test_documents_of_a_stream_do_not_mix():
    sides = [np.array(t, np.int64) for t in samples()]
    assert runs_of(sides) == [brute(t.tolist()) for t in sides]


def test_long_periodic_text_stays_cheap():
    t = np.tile(np.arange(7), 40_000)
    assert runs_of([np.zeros(200_000, np.int64), t]) == [[(0, 200_000, 1)], [(0, len(t), 7)]]


def test_names_that_collide_make_no_runs(monkeypatch):
    monkeypatch.setattr(periodic_runs, "name_of", lambda left, right: (left * np.uint64(3) + right) % np.uint64(5))
    for t in list(samples())[::7]:
        assert runs_of([np.array(t, np.int64)]) == [brute(t)]


TEXTS = [(1, None), (2, ""), (3, " \n"), (4, "a b " * 30), (5, "x " * 23), (6, "é ü é ü " * 40 + "end"), (7, "w" * 3000 + " " + "one two three\n" * 20), (None, "no id " * 50), (8, " ".join(f"w{i}" for i in range(900)))]
TEXTS += [(i, " ".join(f"w{k * k % (5 + i)}" for k in range(40 + 9 * i))) for i in range(9, 140)] + [(4, "a b " * 30)]


def expected(doc, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for a, length, q in runs for i in range(a + q, a + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(runs), *top, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_equals_plain_version(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in TEXTS], "doc_id long, text string, runs int, n_words string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(i, t) for i, t in TEXTS), key=key)
    assert sum(r.n_runs for r in got) > 20


@pytest.mark.parametrize("slice_", [7, 64])
def test_long_texts_in_slices(spark, monkeypatch, slice_):
    from folioscope.llm import word_stream

    monkeypatch.setattr(word_stream, "SLICE", slice_)
    data = b"alpha beta  gamma " * 50 + b"x" * 200 + b" end"
    assert b"".join(word_stream.slices(data)) == data
    assert len(word_stream.Numbered().ids(data)) == len(data.split()) and word_stream.joined(data, np.ones(152, bool)) == " ".join(data.decode().split())


def test_empty_table(spark):
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
