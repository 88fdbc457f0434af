import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import language_id, ngram_join, quality_rules
from folioscope.llm.packing import pieces
from tests.llm.test_ngram_join import brute
from tests.llm.test_quality_language_sharding import rules_of

SF = "/root/testdata/sf0.001"


def classes_of(text):
    j = "".join(re.findall(r"[^\x20\x09-\x0D]+", text))
    c = [sum(x.islower() and x.isalpha() for x in j), sum(x.isupper() and x.isalpha() for x in j), sum(x in "0123456789" for x in j), sum(x in "#*$%&|<>" for x in j)]
    return [*c, len(j) - sum(c)]


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    return math.sqrt(max(0, sum((a * math.log2(a / c) if a > 0 else 0) + (b * math.log2(b / c) if b > 0 else 0) for a, b, c in zip(p, q, m)) / 2))


def plain_good(rows):
    refs = []
    langs = Counter()
    for r in rows:
        if r.lang is not None and r.text is not None:
            langs[r.lang] += len(r.text.split())
    for lang in sorted(langs):
        own = [r.text for r in rows if r.lang == lang and r.text is not None]
        c = np.sum([classes_of(t) for t in own], axis=0)
        n = Counter(w.lower() for t in own for w in t.split() if re.fullmatch(r"[^\W\d_]{1,4}", w))
        common = sorted(n.items(), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_WORDS]
        refs.append((c / c.sum(), [w for w, _ in common], [k / langs[lang] for _, k in common]))
    out = []
    for r in rows:
        x = rules_of(r.text)
        if x[5]:
            continue
        if x[0] >= quality_rules.LEAST_WORDS and x[1] >= quality_rules.LEAST_CHARS:
            c = np.array(classes_of(r.text)) / x[1]
            n = Counter(w.lower() for w in r.text.split())
            share = lambda ws: [n[w] / x[0] for w in ws] + [1 - sum(n[w] for w in ws) / x[0]]
            if min(js(c, q) for q, _, _ in refs) > quality_rules.CHAR_LIMIT or min(js(share(ws), [*q, 1 - sum(q)]) for _, ws, q in refs) > quality_rules.WORD_LIMIT:
                continue
        out.append(r)
    return out


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 50")
    odd = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, None, None, None, None), (9003, "1 2 3 4 5 6 7 " * 30, "de", "s", 9)], real.schema)
    same = real.limit(3)
    return real.unionByName(odd).unionByName(same)


def key(r):
    return tuple("" if x is None else str(x) for x in r)


def test_stages_against_plain_versions(spark, docs, tmp_path):
    rows = docs.collect()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if k == 0:
            want = plain_good(rows)
        elif k == 1:
            model = language_id.train(docs)
            want = []
            for r in rows:
                ws = language_id.words_of((r.text or "").encode())
                if any(map(str.isalpha, r.text or "")):
                    x = model.forward([language_id.as_pieces(w) for w in ws]).sum(0) if ws else np.zeros(len(model.langs))
                    if 1 / np.exp(np.clip(x - x.max(), -700, 0)).sum() >= corpus_pipeline.LEAST_SCORE:
                        want.append(r)
        else:
            groups = {}
            for r, (_, n, comp) in zip(rows, brute([(r.doc_id, r.text) for r in rows], 5, 80, 100)):
                if n == 0 or comp == r.doc_id and (comp, n) not in groups:
                    groups[comp, n] = r
            want = list(groups.values())
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows = docs.collect()
        assert 0 < len(rows)
        assert sorted(map(key, rows)) == sorted(map(key, want)), name
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in rows:
        ids = np.array(full.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        want += [(r.doc_id, s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in pieces(len(ids))]
    got = corpus_pipeline.STAGES[3][1](spark, docs, SF)
    assert sorted(map(tuple, got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == sorted(want)


def test_stages_on_empty_tables(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_one_of_each_group(spark):
    t = " ".join(f"w{i}" for i in range(40))
    rows = [(5, t, "a"), (3, t + " x", "b"), (None, t, "c"), (8, None, "d"), (8, None, "e"), (9, "alone", "f"), (9, "alone", "f"), (9, "another text here", "g"), (None, "null one", "h"), (None, "null one", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, set_id string")
    got = ngram_join.one_of_each_group(docs, 5, 80, 100)
    assert got.columns == docs.columns
    assert sorted(r.set_id[0] for r in got.collect()) in (sorted("bdefgh"), sorted("bdefgi"))
