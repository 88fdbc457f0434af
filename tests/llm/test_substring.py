import hashlib
import pathlib
import random
import re

import numpy as np
import pytest

from folioscope.llm import queries
from folioscope.llm import substring_dedup as S


def plain(rows, width=13):
    words = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                x = tuple(w[k : k + width])
                least[x] = min(least.get(x, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and least[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-99 if i is None else i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def texts(seed=3, n=120):
    rnd = random.Random(seed)
    passages = [" ".join(f"p{k}w{rnd.randrange(40)}" for _ in range(rnd.choice([5, 12, 13, 14, 40, 200]))) for k in range(12)]
    out = []
    for i in range(n):
        parts = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(60))) for _ in range(4)]
        out.append((rnd.randrange(10**6) * 129, rnd.choice([" ", "\n", " \t"]).join(x for p in parts for x in (p, rnd.choice(passages)) if x)))
    base = out[5][1].split()
    out += [(7, out[3][1]), (8, out[3][1] + " more"), (9, " ".join(base[:30] + ["new"] + base[30:])), (10, " ".join(base[30:] + base[:30])), (11, "a b " * 40), (12, "b a " * 30), (13, "x a b a b a b a b a b a b a b"), (14, None), (15, ""), (16, "few words"), (None, out[3][1]), (None, "é ü " * 20)]
    out += [(i, "one copy of a text that has many copies and is long enough to be found by it") for i in range(20, 60)]
    out += [(7, out[3][1]), (7, out[4][1] + " other text of that id")]
    return out


def check(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, n int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-99 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in queries.op11_substring_dedup(spark, str(tmp_path)).collect())
    want = plain(rows)
    assert got == want
    assert sum(x[2] > 0 for x in want) > 40


def test_equals_plain_version(spark, tmp_path):
    check(spark, texts(), tmp_path)


def test_many_slices_and_spread_sources(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "SLICE_WORDS", 500)
    monkeypatch.setattr(S, "COPY_BYTES", 300)
    check(spark, texts(4), tmp_path)


@pytest.mark.parametrize("strength", [0, 3])
def test_windows_with_one_hash(spark, strength):
    """Windows are told apart by their words where hashes do not."""
    rows = texts(5, 60)
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), strength=strength).collect()
    assert sorted((-99 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got) == plain(rows)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketch_is_the_sql_function(spark):
    import xxhash

    got = spark.sql("SELECT xxhash64(cast('some words' AS binary)) AS h").first().h
    assert got == S._signed(xxhash.xxh64_intdigest(b"some words", 42))


@pytest.mark.parametrize("bits", [7, 10])
def test_an_edge_takes_few_bytes_however_many_buckets(bits):
    rnd = np.random.default_rng(1)
    ids, words = [3 * i for i in range(600)], [rnd.integers(0, 2**63, 1000, dtype=np.uint64) for _ in range(600)]
    rows = S.slice_rows(ids, words, S.Graph(bits=bits))
    assert all(home is None for _, home, *_ in rows)
    assert sum(len(x) for _, _, *xs in rows for x in xs) < 7 * 600 * 988
    keys = [(b << 48) + int(k) for b, _, _, k, _ in rows for k in S.ascended(k)[0]]
    assert sorted(keys) == sorted(np.unique(np.concatenate([S.Graph(bits=bits).keys(w) for w in words])).tolist())


@pytest.mark.parametrize("values", [[0], [-(2**63), 2**63 - 1], [-3, -3, 0, 9], list(range(70)), [2**62] * 9])
def test_packed_integers_come_back(values):
    a = np.array(values, np.int64)
    data = S.ascending(a)
    got, end = S.ascended(data + b"more")
    assert end == len(data) and got.view(np.int64).tolist() == values
    for width in (0, 1, 13, 34, 64):
        low = a.view(np.uint64) & np.uint64((1 << width) - 1)
        assert S.unpacked(S.packed(low, width), len(low), width).tolist() == low.tolist()
    keys = np.arange(len(a), dtype=np.uint64)[::-1] << S.SHORT
    docs, short, sources = S.found_arrays(*S.found_bytes(a, keys, a[::-1]))
    assert docs.tolist() == values and short.tolist() == (keys >> S.SHORT).tolist() and sources.tolist() == values[::-1]


def test_no_text_is_kept_and_one_table_at_a_time(spark, monkeypatch):
    made = []

    def checkpointed(df, lasting=False):
        out = original(df, lasting)
        here = [path for _, path, kept in made if not kept and pathlib.Path(path.removeprefix("file:")).exists()]
        assert len(here) <= 1, "a table that nothing will read again is still there"
        made.append((out.columns, out.table_path, lasting))
        return out

    original = S.checkpointed
    monkeypatch.setattr(S, "checkpointed", checkpointed)
    out = S.remove_repeats(spark.createDataFrame(texts(6), "doc_id long, text string"))
    assert out.count() == len(texts(6))
    assert [columns for columns, _, kept in made if kept] == [["doc_id", "text_hash", "start", "n", "words"]]


def test_ranges_are_not_broadcast_at_any_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        out = S.remove_repeats(spark.createDataFrame(texts(7), "doc_id long, text string"))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_many_buckets(spark, tmp_path, monkeypatch):
    """Rows of a bucket and a group stay long where buckets are many."""
    assert (S.Graph(bits=7).homes, S.Graph(bits=12).homes) == (129, 1025)
    monkeypatch.setattr(S, "LEAST_BITS", 10)
    check(spark, texts(8), tmp_path)
