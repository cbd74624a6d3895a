"""Alignment of two tokenizers: lockstep merging and the query against a plain version with the libraries themselves."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import alignment
from tallyspark.llm.queries import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def _plain_merge(a, b):
    """Links by comparing all byte ranges, cuts as the set of common ends."""
    starts_a, starts_b = [0, *a[:-1]], [0, *b[:-1]]
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts_a[i], starts_b[j]) < min(a[i], b[j])]
    return links, [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


@pytest.mark.parametrize("strand", [1, 2, 5, 1000])
def test_lockstep_against_all_ranges(strand):
    rng = random.Random(strand)
    ends_a, ends_b, links, cuts, n, m = [], [], [], [], 0, 0
    for _ in range(60):
        size = rng.choice([0, 1, 2, 9, 40, 300])
        a, b = (sorted({size, *(rng.randint(1, size) for _ in range(rng.randint(0, size)))}) if size else [] for _ in "ab")
        own_links, own_cuts = _plain_merge(a, b)
        links += [(n + i, m + j) for i, j in own_links]
        cuts += [(n + i, m + j) for i, j in own_cuts]
        ends_a.append(np.array(a, np.int64))
        ends_b.append(np.array(b, np.int64))
        n, m = n + len(a), m + len(b)
    got = alignment.lockstep(ends_a, ends_b, strand)
    assert sorted(zip(got.link_a.tolist(), got.link_b.tolist())) == sorted(links)
    assert sorted(zip(got.cut_a.tolist(), got.cut_b.tolist())) == sorted(cuts)


def test_strands_end_at_common_ends():
    a, b = np.arange(1, 5001), np.arange(100, 5001, 100)
    cuts = alignment._common_ends(a, b, 64)
    assert cuts[-1] == (5000, 50) and all(x == 100 * y for x, y in cuts) and len(cuts) == 50
    assert alignment._common_ends(np.arange(1, 301), np.array([300]), 64) == [(300, 1)]


@lru_cache
def _libraries():
    a = Tokenizer.from_file(A)
    a.no_truncation()
    a.no_padding()
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {chr(c): c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in set(letters.values()))}
    return a, b, letters


def _tokens(text):
    a, b, letters = _libraries()
    if not text:
        return [], []
    tokens_a = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tokens_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        tokens_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in tokens_a) != whole or b"".join(x for _, x in tokens_b) != whole:
        return [], []
    return tokens_a, tokens_b


def _want(rows):
    """The contract, token by token."""
    found, holders = [], defaultdict(set)
    for k, (doc_id, text) in enumerate(rows):
        tokens_a, tokens_b = _tokens(text)
        i = j = at_a = at_b = 0
        links, groups, group = [], [], ([], [])
        if tokens_a:
            group = ([tokens_a[0][0]], [tokens_b[0][0]])
            at_a, at_b = len(tokens_a[0][1]), len(tokens_b[0][1])
        while i < len(tokens_a):
            links.append((tokens_a[i][0], tokens_b[j][0]))
            to_a, to_b = at_a <= at_b, at_b <= at_a
            if to_a and to_b:
                groups.append(group)
                group = ([], [])
            if to_a:
                i += 1
                if i < len(tokens_a):
                    at_a += len(tokens_a[i][1])
                    group[0].append(tokens_a[i][0])
            if to_b:
                j += 1
                if j < len(tokens_b):
                    at_b += len(tokens_b[j][1])
                    group[1].append(tokens_b[j][0])
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        found.append((doc_id, len(tokens_a), len(tokens_b), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
        for pair in set(links):
            holders[pair].add(k)
    count = {p: len(k) for p, k in holders.items()}
    top = Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return [
        (doc_id, a, b, g, len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), digest)
        for doc_id, a, b, g, links, digest in found
    ]


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def test_query_on_a_whole_table(spark):
    got = QUERIES["op11_lockstep_alignment"](spark, SF_DIR).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert _sorted(got) == _sorted(_want(rows))
    assert sum(r.n_groups for r in got) > 100_000


ODD = [
    (1, None), (2, ""), (None, "a b"), (3, " "), (3, " "), (None, "a b"), (4, "\n\n  two\tlines \r\n"), (5, "x" * 5000),
    (6, "don't <|endoftext|> <s> </s> <unk> <0x41>"), (7, "lower▁bar"), (8, "日本語のテキスト é é \U0001f600   \u0000 x"),
    (9, "word " * 20_000), (10, "ﬁ ① Ⅷ ² ½ 　 ​ ﻿"), (11, "�"), (-3, "the the the"),
]


def test_odd_rows_in_small_blocks(spark):
    rows = ODD * 2
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], f"{SCHEMA}, pair int, block string").repartition(3)
    got = alignment.alignment(docs, A, B, batch_bytes=40, block_bytes=100, strand_tokens=3)
    assert _sorted(got.collect()) == _sorted(_want(rows))
    assert alignment.alignment(spark.createDataFrame([], SCHEMA), A, B).collect() == []
    empty = spark.createDataFrame([(1, None), (2, "")], SCHEMA)
    assert _sorted(alignment.alignment(empty, A, B).collect()) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_random_texts():
    rng = random.Random(7)
    pools = ["ab '.s tT\n", "é ßİſ 19½²", "日本 한글 　​", "\U0001f600́क्  x\x85\x1c"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    a, b = alignment._byte_level(A), alignment._pieces(B)
    for text, ids_a, ids_b in zip(texts, a.encode([" " + t for t in texts]), b.encode(texts)):
        library_a, library_b, _ = _libraries()
        assert ids_a == library_a.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert ids_b == library_b.encode(text)


def test_pairs_are_shuffled_per_block_only(spark):
    """Rows that leave the tasks: a row per block and distinct pair, one per block for its documents."""
    docs = spark.createDataFrame([(i, "the same words again and again") for i in range(500)], SCHEMA).coalesce(1)
    rows = alignment.aligned(docs, A, B).collect()
    assert sum(r.pair is None for r in rows) == 1
    assert {r.docs for r in rows if r.pair is not None} == {500}
