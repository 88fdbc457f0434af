import math
import random
import struct
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
import zstandard
from pyspark.sql import functions as F

from folioscope.llm import language_id, quality_classifier, quality_rules, sharding
from folioscope.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(rnd, lang, n):
    stock = {"aa": ["the", "of", "and", "tion", "ing"], "bb": ["der", "und", "schicht", "ung", "keit"]}[lang]
    return " ".join("".join(rnd.choice(stock) for _ in range(rnd.randrange(1, 3))) for _ in range(n))


def rules_of(x):
    w = re.findall(r"[^\x20\x09-\x0D]+", x or "")
    n = len(w)
    c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    cover = {k for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    ls = [y for y in (x or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", y)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x or "")), len(ls) - len(set(ls)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_rules_against_plain(spark):
    rnd = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x y z x y z x y", "é漢 \x0b\x0c\r a b c", "l1\nl2\nl1\n\n \nl2", "#*$%&|<> <b>", "w " * 4000]
    texts += [words(rnd, "aa", 80) + f"\nline {i % 3}\nline {i % 3}" for i in range(8)] + [" ".join(str(rnd.randrange(6)) for _ in range(300))] + [words(rnd, "bb", 9000)]
    texts += [words(rnd, "aa", 60).upper(), " ".join(w + "$$$" for w in words(rnd, "aa", 90).split())]
    docs = spark.createDataFrame([(i, t, ["aa", "bb", None][i % 3], 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int, _q int")
    for refs in (quality_rules.learn(docs), quality_rules.References()):
        got = quality_rules.measure(docs, refs)
        assert got.columns == [*docs.columns, "rules"]
        for r in got.collect():
            x = r.rules
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == rules_of(r.text), r.text
            assert x.kept == (not x.base_failed and (x.char_distance or 0) <= quality_rules.CHAR_LIMIT and (x.word_distance or 0) <= quality_rules.WORD_LIMIT)
    empty = docs.limit(0)
    assert quality_rules.measure(empty, quality_rules.learn(empty)).count() == 0


def test_colliding_hashes_are_found(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "POSITION_BITS", 62)  # two bits of the hash: nearly all collide
    texts = [" ".join(str(random.Random(i).randrange(9)) for _ in range(120)) for i in range(6)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.measure(docs, quality_rules.References()).collect():
        assert r.rules.n_repeat_words == rules_of(r.text)[4]


def test_distance(spark):
    p, q = [0.5, 0.25, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    want = math.sqrt(sum((a * math.log2(a / c) if a else 0) + b * math.log2(b / c) for a, b, c in zip(p, q, m)) / 2)
    df = spark.createDataFrame([(p,), (q,)], "p array<double>")
    got = [r[0] for r in df.select(quality_rules.js_distance(df.p, q)).collect()]
    assert abs(got[0] - want) < 1e-9 and got[1] == 0


def test_sharding(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["hot"] * 6 + ["b", "c", None] + [f"s{i}"]), rnd.choice([None, "", "é" * 5, "x" * 100])) for i in range(1500)] + [(7, "b", "x"), (7, "b", "x"), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    few = docs.where("source IS NULL OR source NOT LIKE 's%'")
    for k, docs, exact in ((24, few, True), (1, docs, False), (24, docs, False)):
        got = sharding.assign_shards(sharding.text_rows(docs), k, ties=("text_crc32", "size")).collect()
        assert len(got) == docs.count()
        shards = Counter(r.shard for r in got)
        assert set(shards) == set(range(k)) and max(shards.values()) - min(shards.values()) <= 1
        assert all(sorted(r.slot for r in got if r.shard == s) == list(range(shards[s])) for s in shards)
        for s in ("hot", "b", "c", None) if exact else ():  # every shard has a source's share, up to two rows
            own = Counter(r.shard for r in got if r.source == s)
            assert max(own[x] for x in range(k)) - min(own[x] for x in range(k)) <= 2
    size = {(r.doc_id, r.source): (r.size, r.text_crc32) for r in got}
    assert all(size[i, s] == (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, s, t in rows)
    assert sharding.assign_shards(sharding.text_rows(docs.limit(0)), 24).count() == 0
    again = {(r.doc_id, r.size): (r.shard, r.slot) for r in sharding.assign_shards(sharding.text_rows(docs.repartition(7)), 24, ties=("text_crc32", "size")).collect()}
    assert sum(again[r.doc_id, r.size] != (r.shard, r.slot) for r in got) <= 3  # equal rows may swap places


def test_forward_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    p = np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.2], [0.1, 0.1], [0.2, 0.2], [0.1, 0.1]])
    m = language_id.Model(["x", "y"], pieces, np.vstack([np.zeros(2), p]), 1e-9)

    def ways(w, k):
        return 1.0 if not w else sum(p[i, k] * ways(w[len(x) :], k) for i, x in enumerate(pieces) if w.startswith(x)) + 1e-9 * ways(w[1:], k)

    tries = ["▁abab", "▁ba", "▁aabbab", "▁c", "▁abcab"]
    got = m.forward(tries)
    for w, row in zip(tries, got):
        for k in (0, 1):
            assert abs(row[k] - math.log(ways(w, k))) < 1e-9
    long = m.forward(["▁" + "ab" * 5000])
    assert np.isfinite(long).all() and abs(m.forward(["▁" + "ab" * 40])[0, 0] - math.log(ways_fast(pieces, p[:, 0], "▁" + "ab" * 40))) < 1e-6


def ways_fast(pieces, p, w):
    a = [1.0] + [0.0] * len(w)
    for j in range(1, len(w) + 1):
        a[j] = a[j - 1] * 1e-9 + sum(a[j - len(x)] * p[i] for i, x in enumerate(pieces) if w[:j].endswith(x) and j >= len(x))
    return a[-1]


def test_languages(spark):
    rnd = random.Random(1)
    rows = [(i, words(rnd, x, 60), x, 5) for i in range(60) for x in [rnd.choice(["aa", "bb"])]] + [(90, None, "aa", 5), (91, "", None, 5), (92, "123 !? 漢"[:6], None, 5), (93, words(rnd, "bb", 5000), None, 5), (None, words(rnd, "aa", 9), None, 5), (90, None, "aa", 5), (94, "漢字", None, 5), (95, "9" * 50_000 + " " + "q" * 50_000, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.train(docs)
    assert model.langs == ["aa", "bb"]
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    assert len(language_id.predict(docs, model).collect()) == len(rows)
    for i, _, x, _ in rows[:60]:
        assert got[i].lang_pred == x and 0.5 < got[i].score <= 1
    assert [got[i].lang_pred for i in (90, 91, 92)] == ["und"] * 3 and got[93].lang_pred == "bb" and got[None].lang_pred == "aa" and got[94].lang_pred in ("aa", "bb")
    assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "score"]
    none = language_id.train(docs.limit(0))
    assert language_id.predict(docs.limit(0), none).count() == 0 and {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


def test_language_accuracy(spark):
    rows = QUERIES["op2_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0


def test_quality(spark):
    rnd = random.Random(3)
    rows = [(i, words(rnd, "aa", 60) if i % 2 else words(rnd, "bb", 60).upper()) for i in range(80)] + [(200, None), (201, ""), (None, "x"), (202, "y " * 60_000), (1, rnd.choice("abc"))]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(300, None, 1), (301, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    s = {r.doc_id: r.score for r in got}
    assert np.mean([s[i] for i in range(3, 80, 2)]) > 0.8 > 0.2 > np.mean([s[i] for i in range(2, 80, 2)])
    bare = quality_classifier.train(docs, labels.limit(0))
    assert {r.score for r in quality_classifier.score(docs, bare).collect()} == {0.5} and quality_classifier.score(docs.limit(0), bare).count() == 0


def test_quality_does_not_learn_from_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_classifier.held_out(labels.doc_id, 5, 0)
    clean = quality_classifier.train(docs, labels.where(~out))
    swapped = labels.where(~out).unionByName(labels.where(out).selectExpr("doc_id", "1 - quality AS quality", "toxic"))
    assert quality_classifier.train(docs, swapped.where(~out)) == clean
    rows = QUERIES["op1_quality_classifier"](spark, SF).select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_text_without_common_words_is_rejected(spark):
    rnd = random.Random(5)
    clean = [" ".join(rnd.choice(["the", "of", "and", "to"]) if rnd.random() < 0.25 else f"{''.join(rnd.choice('abcdefgh') for _ in range(7))}" for _ in range(120)) for _ in range(40)]
    without = " ".join("".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(120))
    rows = [(i, t, "aa") for i, t in enumerate(clean)] + [(100, without, "aa"), (101, without + " z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rules for r in quality_rules.measure(docs, quality_rules.learn(docs)).collect()}
    assert all(got[i].kept for i in range(40))
    for i in (100, 101):
        assert not got[i].base_failed and got[i].char_distance <= quality_rules.CHAR_LIMIT and not got[i].kept
    # a language whose texts need not hold any common word is not judged by them
    spaceless = ["".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(60)]
    rows += [(200 + i, " ".join(f"{x}{i}" for x in spaceless), "zz") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.rules for r in quality_rules.measure(docs, quality_rules.learn(docs)).collect()}
    assert not got[100].kept and all(got[200 + i].kept and got[200 + i].word_distance is None for i in range(3))


def many_languages(n, rnd):
    """Texts of n languages; each language's last one is laden with symbols. Then junk and clean texts without a language."""
    def text(k, words):
        return " ".join(rnd.choice([f"{a}{chr(97 + k)}" for a in "xyzw"]) if rnd.random() < 0.3 else "".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(words))

    rows = [(f"l{k:02}", text(k, 90)) for k in range(n) for _ in range(8)]
    bad = [(f"l{k:02}", " ".join(w + "#" * len(w) for w in text(k, 90).split())) for k in range(n)]
    junk = " ".join("%$|" * 3 + w for w in text(0, 80).split())
    return rows, bad, [(None, junk), (None, text(0, 90)), ("rare", text(1, 90))]


def test_any_number_of_languages(spark):
    """20 languages are judged as 4 or 16 are, whether distances are spelt out or taken over an array."""
    for n in (4, 16, 17, 20):
        rows, bad, others = many_languages(n, random.Random(6))
        docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate([*rows, *bad, *others])], "doc_id long, text string, lang string")
        refs = quality_rules.learn(docs.where("lang <> 'rare'"))
        assert len(refs.langs) == n
        got = {r.doc_id: r.rules for r in quality_rules.measure(docs, refs).collect()}
        assert all(got[i].kept for i in range(len(rows)))
        assert all(not got[i].base_failed and not got[i].kept and got[i].char_distance > quality_rules.CHAR_LIMIT for i in range(len(rows), len(rows) + n))
        last = [got[len(rows) + n + k] for k in range(3)]
        assert [r.kept for r in last] == [False, True, True] and last[0].char_distance > quality_rules.CHAR_LIMIT


def test_both_ways_to_the_nearest_language_are_equal(spark, monkeypatch):
    rows, bad, others = many_languages(5, random.Random(7))
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate([*rows, *bad, *others, ("l01", None), ("l01", ""), ("l02", "short text")])], "doc_id long, text string, lang string")
    refs = quality_rules.learn(docs)
    want = {r.doc_id: r.rules for r in quality_rules.measure(docs, refs).collect()}
    monkeypatch.setattr(quality_rules, "SPELT_OUT", 2)
    got = {r.doc_id: r.rules for r in quality_rules.measure(docs, refs).collect()}
    for i, r in want.items():
        same = lambda a, b: a is None and b is None or abs(a - b) < 1e-9
        assert r.kept == got[i].kept and same(r.char_distance, got[i].char_distance) and same(r.word_distance, got[i].word_distance)


def test_rare_languages_have_no_reference(spark, monkeypatch):
    rows, _, _ = many_languages(3, random.Random(8))
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate([*rows, ("few", "a b c")])], "doc_id long, text string, lang string")
    assert len(quality_rules.learn(docs).langs) == 4
    monkeypatch.setattr(quality_rules, "LEAST_SHARE", 0.01)
    assert quality_rules.learn(docs).langs == ["l00", "l01", "l02"] or sorted(quality_rules.learn(docs).langs) == ["l00", "l01", "l02"]


def test_learning_reads_all_parts_of_a_text(spark):
    from folioscope.llm.common import spread_over

    texts = [b"", b"short", bytes(range(97, 123)) * 40, b"0123456789" * 5000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t binary").select("i", spread_over(F.col("t"), 2050, 1024).alias("b")).collect()
    got = {r.i: bytes(r.b) for r in rows}
    assert [got[i] for i in range(3)] == texts[:3]
    assert got[3] == texts[3][:1024] + b" " + texts[3][-1024:] + b" "
    samples = [b"a" * 1000 + b"b" * 1000 + b"c" * 1000 for _ in range(30)]
    assert set(quality_classifier.dictionary(samples, 3000)) == set(b"abc")


def long_hash(values, seed=42):
    """Spark's xxhash64 of longs, a null leaves the hash as it is; ints are given as bytes."""
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v if isinstance(v, bytes) else struct.pack("<q", v), seed=seed).intdigest()
    return seed


def plain_shards(rows, n, seed=20):
    """(shard, slot) of each row (doc_id, source, size, text_crc32): sources shuffled by seed, all sorted by fractional rank, cut evenly."""
    sources = {}
    for i, (doc, source, size, crc) in enumerate(rows):
        name = "-" if source is None else "+" + source
        h = long_hash([struct.pack("<i", seed), doc, crc, size])
        sources.setdefault(name, []).append((h, (doc is not None, doc or 0), crc, size, i))
    order = []
    for name, members in sources.items():
        hashed = xxhash.xxh64(name.encode(), seed=long_hash([struct.pack("<i", seed)])).intdigest()
        phase = (hashed % (1 << 20) + 0.5) / (1 << 20)
        order += [((r - phase) / len(members), name, r, m[-1]) for r, m in enumerate(sorted(members), 1)]
    out = [None] * len(rows)
    for p, (_, _, _, i) in enumerate(sorted(order)):
        shard = p * n // len(rows)
        out[i] = (shard, p - (shard * len(rows) + n - 1) // n)
    return out


def test_sharding_against_a_plain_version(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "b", "b", "b", "é", None]), rnd.randrange(9, 5000), rnd.randrange(1 << 32)) for i in range(3000)]
    rows += [(None, "b", rnd.randrange(9, 5000), rnd.randrange(1 << 32)) for _ in range(400)] + [(7, "b", 10, k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long, text_crc32 long")
    for n in (24, 7, 5000):
        want = sorted((str(r), *p) for r, p in zip(rows, plain_shards(rows, n)))
        got = sharding.assign_shards(docs.repartition(5), n, ties=("text_crc32", "size")).collect()
        assert sorted((str(tuple(r[:4])), r.shard, r.slot) for r in got) == want
    clash = sharding.assign_shards(docs.withColumnsRenamed({"size": "Shard", "text_crc32": "slot"}), 3)
    assert clash.columns == ["doc_id", "source", "Shard", "slot", "shard_", "slot_"] and clash.count() == len(rows)


def test_quality_against_a_plain_version(spark):
    """Dictionaries, sizes and curve worked out anew from the description, the curve by plain gradient steps."""
    rnd = random.Random(13)
    texts = [(words(rnd, "aa", rnd.randrange(5, 90)) if i % 3 else words(rnd, "bb", rnd.randrange(5, 90))) for i in range(90)]
    texts[5], texts[6] = texts[8], "x" * 5000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0 or i == 9)) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, quality_classifier.train(docs, labels)).collect()}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    by = {q: [texts[i].encode()[: quality_classifier.BYTES_A_ROW] for i in sorted(range(60), key=lambda i: (signed(long_hash([i])), i)) if int(i % 3 > 0 or i == 9) == q] for q in (0, 1)}
    size = [len(by[0]), len(by[1])]
    dictionaries = []
    for q in (1, 0):
        first = by[q][0::2]
        dictionaries.append(quality_classifier.dictionary(first))
        assert all(t[:60] in dictionaries[-1] for t in first)

    def feature(t):
        packed = []
        for d in dictionaries:
            z = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False, write_checksum=False)
            packed.append(sum(len(z.compress(t[k : k + 1024])) for k in range(0, len(t), 1024)))
        return [(packed[1] - packed[0]) / max(1, sum(packed)), packed[0] / max(1, len(t)), math.log1p(len(t))]

    rest = [(feature(t), q, size[q] / 60 / len(by[q][1::2])) for q in (0, 1) for t in by[q][1::2]]
    x, y, w = (np.array(v, float) for v in zip(*rest))
    w = w * len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9

    def curve(f):
        z = (np.array(f) - mean) / scale
        return np.array([1, *z, *[z[i] * z[j] for i in range(3) for j in range(i, 3)]])

    m = np.array([curve(f) for f in x])
    b = np.zeros(10)
    for _ in range(60_000):
        b -= 0.002 * (m.T @ (w * (1 / (1 + np.exp(-m @ b)) - y)) + b)
    for i, t in enumerate(texts):
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(curve(feature(t.encode())) @ b, -30, 30)))) < 1e-3, i
    # ties: equal texts score alike
    assert got[5] == got[8]
