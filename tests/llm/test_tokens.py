import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from folioscope.llm.bpe_codec import Codec, encode_decode
from folioscope.llm.packing import ByteBpe, default_files, pack, pieces

TEXTS = [
    None, "", " ", "a", "Hello, wörld! it's", "two  spaces", "line\nbreak \n next\t", " lead", "trail ", "漢字かな éé ́x", "ΑΣ ΣΑΣ İstanbul",
    "a<|endoftext|>b <|startoftext|> c", "éé ñçß Über!!", "x" * 5000, "it's we'LL 'S 's", "\x1c\x1d a\x85b c d", "1234567 89", "\U0001f600‍️ ok", "ǆ ŉ ǰ", "the of and " * 900,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)] + [(None, "null id", "y", 1), (3, "a", "x", 7)], "doc_id long, text string, ids string, length int")


def test_units_equal_tokenizer():
    files = default_files()
    ours, full = ByteBpe(*files), Tokenizer.from_file(files[0])
    for t in TEXTS:
        assert np.frombuffer(ours.ids(t or ""), "<u4").tolist() == full.encode(t or "", add_special_tokens=False).ids, t


def test_pieces_are_binary():
    for n in range(1, 3000):
        got = list(pieces(n))
        assert sum(x for _, x in got) == n and all(x & (x - 1) == 0 and x <= 1024 for _, x in got)
        assert [s for s, _ in got] == [sum(x for _, x in got[:i]) for i in range(len(got))]


def test_pack_covers_each_id_once(spark, docs):
    full = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = pack(docs, with_ids=True).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    by = {}
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length == 1 << r.bucket
        by.setdefault(r.doc_id, {})[r.start] = r.ids
    for i, t in enumerate(TEXTS):
        assert [x for s in sorted(by[i]) for x in by[i][s]] == full.encode(t or "", add_special_tokens=False).ids + [0]
    assert pack(docs.limit(0)).count() == 0


def test_codec_equals_tokenizer(spark, docs):
    full, codec = Tokenizer.from_file(P.path("word_bpe_49k.json")), Codec(P.path("word_bpe_49k.json"))
    rows = {r.doc_id: r for r in encode_decode(docs, with_values=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = full.encode(t or "", add_special_tokens=False).ids
        back = full.decode(ids, skip_special_tokens=False)
        assert rows[i].ids == ids and rows[i].decoded == back and codec.decode(ids) == back
        assert rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and rows[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert encode_decode(docs.limit(0)).count() == 0


def test_codec_cuts_words():
    codec = Codec(P.path("word_bpe_49k.json"))
    assert any(len(codec.fragments.split(w)) > 1 for w in codec.pretokens("qzqxjq zxqj"))


def test_codec_on_real_rows(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    full, codec = Tokenizer.from_file(P.path("word_bpe_49k.json")), Codec(P.path("word_bpe_49k.json"))
    files = default_files()
    ours, byte = ByteBpe(*files), Tokenizer.from_file(files[0])
    for r in rows:
        assert codec.encode(r.text) == full.encode(r.text, add_special_tokens=False).ids
        assert np.frombuffer(ours.ids(r.text), "<u4").tolist() == byte.encode(r.text, add_special_tokens=False).ids
