"""Wavelet shards: rank, select and round trips against plain lists, and the query on a whole table."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import wavelet
from tallyspark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def _shard(rng, n, planes=16, top=49408):
    ids = (rng.zipf(1.3, n) % top).astype(np.uint16 if planes <= 16 else np.uint32)
    docs, left = [(None, 0)], n
    while left:
        size = min(left, int(rng.integers(1, 60)))
        docs.append((int(rng.integers(1 << 60)), size))
        left -= size
    return ids, docs, wavelet.write_shard(ids, docs, planes, part=3, before=77)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 127, 128, 129, 3000])
@pytest.mark.parametrize("planes,top", [(16, 49408), (17, 100_000), (3, 8)])
def test_access_count_and_occurrences(monkeypatch, n, planes, top):
    monkeypatch.setattr(wavelet, "BLOCK_BYTES", 16)  # many blocks in a plane
    rng = np.random.default_rng(n)
    ids, docs, data = _shard(rng, n, planes, top)
    shard = wavelet.Shard(data)
    assert (shard.part, shard.before, len(shard)) == (3, 77, n)
    assert list(zip(shard.doc_ids, np.diff(shard.ends, prepend=0).tolist())) == docs
    assert shard.ids().tolist() == ids.tolist()
    for i in rng.integers(0, n, 25).tolist() if n else []:
        token = int(ids[i])
        a, b = sorted(rng.integers(0, n + 1, 2).tolist())
        assert shard.access(i) == token
        assert shard.count(token) == (ids == token).sum()
        assert shard.count(token, a, b) == (ids[a:b] == token).sum()
        assert shard.occurrences(token, a, b).tolist() == (a + np.flatnonzero(ids[a:b] == token)).tolist()
    absent = max(set(range(top)) - set(ids.tolist()), default=-2)
    for token in (absent, -1, 1 << 40):
        assert shard.count(token) == 0 and not len(shard.occurrences(token))
    with pytest.raises(IndexError):
        shard.access(n)


def test_broken_shards():
    data = _shard(np.random.default_rng(0), 500)[2]
    for bad in (data[:-1], b"X" + data[1:]):
        with pytest.raises(ValueError):
            wavelet.Shard(bad)
    with pytest.raises(ValueError):
        wavelet.write_shard(np.arange(5, dtype=np.uint16), [(1, 4)], 16)


def test_file_is_smaller_than_its_ids():
    rng = np.random.default_rng(1)
    ids = rng.choice(300, 200_000, p=np.arange(300, 0, -1) / 45150).astype(np.uint16)
    assert len(wavelet.write_shard(ids, [(1, len(ids))], 16)) < 0.7 * 2 * len(ids)


def _want(rows):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    start, out = 0, []
    for doc_id, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_on_a_whole_table(spark):
    got = [tuple(r) for r in QUERIES["op12_wavelet_shards"](spark, SF_DIR).orderBy("start").collect()]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    assert got == _want(docs)


def test_odd_rows(spark):
    long = "word " * 30_000
    rows = [(5, "b c"), (None, None), (3, ""), (5, "b c"), (2, long), (None, "x"), (4, " \n"), (2, long), (-1, "é日本")]
    docs = spark.createDataFrame([(*r, "mine", 7) for r in rows], f"{SCHEMA}, part string, before int").repartition(3)
    got = wavelet.stored_documents(docs, PATH, shard_tokens=50).collect()
    assert sorted(r.start for r in got) == [r.start for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.start))]
    want = _want(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] is not None, r[0] or 0, r[2], r[3]) for r in want)
    assert sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    assert wavelet.stored_documents(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_occurrences_over_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "red blue red" if i % 3 else "blue") for i in range(40)], SCHEMA).repartition(4)
    wavelet.write_shards(docs, f"{tmp_path}/s", PATH, shard_tokens=10)
    tokenizer = Tokenizer.from_file(PATH)
    red, blue = tokenizer.encode("red blue", add_special_tokens=False).ids
    got = sorted(map(tuple, wavelet.token_occurrences(spark, f"{tmp_path}/s", [red, blue, red, 40_000]).collect()))
    want = [(t, i, k) for i in range(40) for k, t in enumerate([red, blue, red] if i % 3 else [blue]) if t in (red, blue)]
    assert got == sorted(want)
