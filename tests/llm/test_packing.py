"""Packing: exact round trip against the tokenizer on whole texts."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyspark.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, part string"
TEXTS = [None, "", " \n", "a<|endoftext|>b <|startoftext|>", "Σίσυφος ΟΔΟΣ İstanbul ǅ", "don't DON'T it'S x2y 3½ \x1c a\x85b\xa0c",
         "é é ﬁ 漢字 🙂", "a_b--c''d ''' 'll", "\x0b\x0ca\rb", "word " * 9000, "Ÿ ÿ ß ŉ 'S ×÷ ªº", "x" * 5000]


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(rows, ids, window=4096):
    """Every piece holds its ids, the windows are full and gapless."""
    by_row, fill = {}, {}
    for r in rows:
        piece = np.frombuffer(r.ids, "<u4")
        assert len(piece) == r.length > 0 and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        assert r.offset + r.length <= window
        by_row.setdefault(r.doc_id, []).append((r.start, piece.tolist(), r.doc_tokens))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, want in ids.items():
        pieces = sorted(by_row.pop(doc_id))
        assert [x for _, p, _ in pieces for x in p] == want and {n for *_, n in pieces} == {len(want)}
        assert [s for s, *_ in pieces] == np.cumsum([0, *(len(p) for _, p, _ in pieces)])[:-1].tolist()
    assert not by_row
    total = sum(map(len, ids.values()))
    assert sorted(fill) == list(range(-(-total // window)))
    for k, parts in fill.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == (window if k < max(fill) else total - window * max(fill))


def test_texts(spark):
    rows = [(k, t, "x", None) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(K.pack(docs, PATH).collect(), dict(enumerate(whole(TEXTS))))
    check(K.pack(docs, PATH, window=7).collect(), dict(enumerate(whole(TEXTS))), 7)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    check(K.pack(docs, PATH).collect(), dict(zip([r.doc_id for r in rows], whole([r.text for r in rows]))))


def test_small_cache():
    texts = [r or "" for r in TEXTS]
    e = K.Encoder(PATH, cache=1)
    assert [np.frombuffer(x, e.kind).tolist() for t in texts for x in e.encode_many([t])] == [x[:-1] for x in whole(texts)]


def test_plain_characters_split_alike():
    e = K.Encoder(PATH)
    for apostrophe in ("", " it's ''d"):
        text = "".join(f"{c}a {c}{c} 1{c}" for c in map(chr, range(0x20, 0x180)) if c != "'" and not K.NOT_PLAIN.search(c)) + apostrophe
        assert not K.NOT_PLAIN.search(text)
        many = [text, "", " ", text[:50], "x", "\t", text]
        got = [np.frombuffer(x, e.kind).tolist() for x in e.encode_many(many)]
        assert got == [x[:-1] for x in whole(many)]


def test_empty_and_repeated(spark):
    assert K.pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = [(1, "same text", "x", "y"), (1, "same text", "x", "y"), (None, "", "x", "y")]
    got = K.pack(spark.createDataFrame(rows, SCHEMA), PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 1), (1, 3), (1, 3)]
