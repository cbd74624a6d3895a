"""Unigram encoding against the library, a plain Viterbi, and exact round trips."""

import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tallyspark.llm import sentencepiece_unigram as U
from tallyspark.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"
TEXTS = [None, "", " ", "   ", "a  b ", "plain words, here.", "漢字かな 🙂 ok‍ Ωmega", "▁x ▁▁ y", "a\n\n\tb\x00c",
         "<s></s><unk> <0x41>", "é é ﬁ 𝔘𝔫 ಠ_ಠ", "x" * 3000, "word " * 20000]


@pytest.fixture(scope="module")
def library():
    """The library, with the same pieces taken as a unigram model.

    Fifteen runs of markers score -1e9 in the file. The library adds scores in
    single precision, and so far from zero it no longer tells pieces apart;
    they score -40000 here, which is still below all others.
    """
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(PATH, "rb").read())
    proto.trainer_spec.model_type = sentencepiece_model_pb2.TrainerSpec.UNIGRAM
    for piece in proto.pieces:
        piece.score = max(piece.score, -40000.0)
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@pytest.fixture(scope="module")
def model(library):
    return U.UnigramModel.of(library)


def plain(model, word):
    """Viterbi by dictionary over one word, unknown characters as their bytes."""
    if not hasattr(model, "table"):
        model.table = {p: i for i, p in enumerate(model.pieces) if not model.control[i] and i not in model.bytes_of}
    table = model.table
    best = [(0.0, 0, None)] + [None] * len(word)
    for s in range(len(word)):
        ends = [s + n for n in range(1, 17) if s + n <= len(word) and word[s : s + n] in table]
        options = [(e, model.scores[table[word[s:e]]], table[word[s:e]]) for e in ends]
        if s + 1 not in ends:
            options.append((s + 1, model.unknown_score, None))
        for e, score, i in options:
            if best[e] is None or best[s][0] + score > best[e][0]:
                best[e] = (best[s][0] + score, s, i)
    out, e = [], len(word)
    while e:
        _, s, i = best[e]
        out = ([model.byte_ids[b] for b in word[s:e].encode()] if i is None else [i]) + out
        e = s
    return out


def test_words_match_plain_and_library(model, library, spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    words = sorted({w for r in rows for w in r.text.split()}) + ["ಠ_ಠ", "🙂", "x" * 400, "漢字かな"]
    got = model.encode_words([U.MARKER + w for w in words])
    assert [g.tolist() for g in got] == [library.encode(w) for w in words]
    assert [g.tolist() for g in got[-300:]] == [plain(model, U.MARKER + w) for w in words[-300:]]


def test_texts(model, library):
    encoder = U.Encoder(model)
    for t, ids in zip(TEXTS, encoder.encode_many([t or "" for t in TEXTS])):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == [i for w in U.split_words(t or "") for i in plain(model, w)]
        if len(t or "") < 100:
            assert ids == library.encode(t or "") and model.decode(ids) == library.decode(ids)
        if U.MARKER not in (t or ""):
            assert model.decode(ids) == (t or "")


def test_whole_texts_match_the_library(model, library, spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for t, ids in zip(texts, U.Encoder(model).encode_many(texts)):
        ids = np.frombuffer(ids, "<u4").tolist()
        assert ids == library.encode(t) and model.decode(ids) == t


def test_the_file_as_it_is(spark):
    """The scores of the file, added exactly, against the plain version."""
    model = U.UnigramModel.load(PATH)
    words = U.split_words(" ".join(r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(20).collect()))
    words += U.split_words("a  b     c" + " " * 40 + "d")
    assert [g.tolist() for g in model.encode_words(words)] == [plain(model, w) for w in words]


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"bcd", b"\x00"]
    trie = U.DoubleArray(keys, list(range(len(keys))))

    def find(key):
        node = np.zeros(1, np.int64)
        for b in key:
            node = trie.step(node, np.array([b]))
            if node[0] < 0:
                return -1
        return int(trie.value[node[0]])

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in (b"c", b"bc", b"abcd", b"\xff", b"")] == [-1] * 5


def test_queries_and_round_trip(spark):
    rows = [(k, t, "x", None) for k, t in enumerate(TEXTS)] + [(30, "twice", "", ""), (30, "twice", "", ""), (None, "é", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = U.encoded(docs, PATH)
    back = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in U.decoded(ids, PATH).collect())
    want = sorted((-1 if i is None else i, (t or "").replace(U.MARKER, " ")) for i, t, *_ in rows)
    assert back == want
    assert U.encoded(docs, PATH).count() == len(rows)
    by_id = {r.doc_id: bytes(r.ids) for r in ids.collect()}
    for r in U.encoding_report(docs, PATH).collect():
        assert (r.n_tokens, r.ids_crc32) == (len(by_id[r.doc_id]) // 4, zlib.crc32(by_id[r.doc_id]))
    assert U.encoding_report(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_long_words_as_short_ones(model, monkeypatch):
    """The path for long words gives what the tables give, also where its chunks end inside of pieces."""
    rng = random.Random(12)
    letters = "abcdethnsx" + "日本語漢字中文" + "é\u0301🙂\x00" + "▁"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(400)]
    raw = [w.encode() for w in words]
    want = [ids.tolist() for ids in model._viterbi(raw)]
    for starts in (7, 64, 1 << 16):
        monkeypatch.setattr(U, "STARTS", starts)
        assert [model._long(r).tolist() for r in raw] == want


def test_text_without_spaces_is_not_slow(model):
    rng = random.Random(13)
    han = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(200_000))
    latin = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))

    def took(text):
        start = time.perf_counter()
        ids = np.frombuffer(U.Encoder(model).encode_many([text])[0], "<u4")
        assert model.decode(ids.tolist()) == text
        return time.perf_counter() - start

    for text in (han, latin):
        spaced = " ".join(text[i : i + 5] for i in range(0, len(text), 5))
        assert took(text) < 3 * took(spaced) + 2


def test_query_decodes_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_unigram_encoding"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].decoded_crc32 == zlib.crc32((r.text or "").encode())
        assert got[r.doc_id].round_trip
    odd = spark.createDataFrame([(1, "a▁b"), (2, None), (3, "  x  y \n"), (None, "🙂\u0000é")], "doc_id long, text string")
    trips = {r.doc_id: r.round_trip for r in U.encoding_report(odd, PATH).collect()}
    assert trips == {1: False, 2: True, 3: True, None: True}
