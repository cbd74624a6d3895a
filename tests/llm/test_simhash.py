"""SimHash near-duplicates against a plain Python version."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from tallyspark.llm import simhash as S
from tallyspark.llm.components import components

SCHEMA = "doc_id long, text string, fp string, key string"


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [w] if len(w) < 3 else [w[i : i + 3] for i in range(len(w) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, bits=3):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fps = np.array(fps, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits) + i + 1:
            parent[find(int(j))] = find(i)
    low = defaultdict(list)
    for i, x in enumerate(ids):
        low[find(i)].append(x)
    return [min((x for x in low[find(i)] if x is not None), default=None) for i in range(len(ids))]


TEXTS = [None, "", "  \n", "one", "One two", "one  TWO\tthree", "a b c d e f g", "É é Éa ÄB c", "x " * 40000,
         "the the the the the", "nbsp\xa0joined word here", "漢字 かな 🙂 ok"]


def test_fingerprints(spark):
    rows = [(k, t, "x", None) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r.fp % (1 << 64) for r in S.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: plain_fingerprint(t) for k, t, *_ in rows}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    want_fp = [plain_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip(want_fp, plain_components([r.doc_id for r in rows], want_fp))))
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == want


def _near(rng, centre, n, bits):
    out = set()
    while len(out) < n:
        x = centre
        for b in rng.sample(range(64), bits):
            x ^= 1 << b
        out.add(x)
    return out


def test_links_lose_nothing(spark):
    """Dense groups, chains and strangers, with keys split into pieces."""
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(1500)} | {0}
    for _ in range(3):
        fps |= _near(rng, rng.getrandbits(64), 250, 2)
    x = rng.getrandbits(64)
    for k in range(60):
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(x)
    fps = sorted(fps)
    want = plain_components(fps, fps)
    frame = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    for blocks, chunk in ((6, 4096), (6, 16), (4, 64), (7, 4096)):
        links = S.fingerprint_links(frame, blocks=blocks, chunk=chunk)
        got = {r.node % (1 << 64): r.component for r in components(links).collect()}
        groups = defaultdict(set)
        for f in fps:
            groups[got.get(f, f)].add(f)
        assert {frozenset(g) for g in groups.values()} == {
            frozenset(f for f, w in zip(fps, want) if w == c) for c in set(want)
        }


def test_distances_of_pivots_bound_the_bits():
    rng = random.Random(5)
    refs = S.references()
    x = rng.getrandbits(64)
    near = np.array(sorted(_near(rng, x, 200, 3)), np.uint64)
    table = S.pivot_table(np.append(near, np.uint64(x)), refs).astype(int)
    assert np.abs(table[:-1] - table[-1]).max() <= 3
    keys = S.join_keys(np.append(near, np.uint64(x)), refs, 6, 3)
    assert ((keys[:-1] == keys[-1]).any(axis=1)).all()


def _signed(fps):
    return [(int(np.uint64(f).astype(np.int64)),) for f in fps]


def test_calls_of_a_hot_key_stay_small(spark):
    """40,000 fingerprints that share 32 bits: no call holds more than two pieces, or the small keys of a call."""
    rng = random.Random(9)
    fps = {rng.getrandbits(32) << 32 | 0x1234ABCD for _ in range(40_000)}
    rows = S.key_rows(spark.createDataFrame(_signed(fps), "fp long"))
    sizes = rows.groupBy("call").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 2.2 * S.CHUNK
    assert sizes.count() > 2 * (40_000 // S.CHUNK) ** 2 // 2


def test_pivots_discard_pairs(spark):
    """The largest coordinate difference discards most pairs that share a key by chance, and none that are near."""
    rng = random.Random(4)
    low = [rng.getrandbits(40) for _ in range(4)]
    fps = sorted({x | rng.getrandbits(24) << 40 for x in low for _ in range(300)} | _near(rng, rng.getrandbits(64), 100, 2))
    table = spark.createDataFrame(_signed(fps), "fp long")
    report = S.pair_report(table).first()
    assert report.pairs == report.discarded + report.verified
    assert report.discarded > 0.7 * report.pairs and report.verified < 4 * report.links
    every = np.array(fps, np.uint64)
    dist = S.pivot_table(every, S.references()).astype(np.int8)
    i, j = np.triu_indices(len(every), 1)
    left = S.within(dist, i, j, 3)
    near = np.flatnonzero(np.bitwise_count(every[i] ^ every[j]) <= 3)
    assert set(near.tolist()) <= set(left.tolist()) and len(left) < len(i) // 20
    assert S.within(dist, 0, np.arange(len(every)), 3).tolist() == [y for y in range(len(every)) if np.abs(dist[0] - dist[y]).max() <= 3]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(docs).count() == 0
    report = S.pair_report(spark.createDataFrame([], "fp long")).first()
    assert tuple(report) == (0, 0, 0, 0)


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(1000, 1400)] + [(5, 5), (None, 3), (2000, 1399)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {7: 7, 2000: 7} | {k: 7 for k in range(1000, 1400)}
