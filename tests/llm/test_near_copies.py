"""Near copies by five-word shingles against a comparison of all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyspark.llm import near_copies as N

SCHEMA = "doc_id long, text string, fp string, component string"


def plain_shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def plain_first(rows, threshold=0.8):
    """For each row (doc_id, text) the number of its component, by comparing all pairs that share a shingle."""
    sets = [plain_shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s or {None}:
            holders[x].append(i)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    pairs = {(a, b) for who in holders.values() for k, a in enumerate(who) for b in who[k + 1 :]}
    links = [(a, b) for a, b in pairs if jaccard(sets[a], sets[b]) >= threshold]
    for a, b in links:
        parent[find(a)] = find(b)
    return [find(i) for i in range(len(rows))], links


def vary(rng, words, similarity):
    """`words` with some replaced, so that the similarity to them is just above."""
    words, own = list(words), plain_shingles(" ".join(words))
    last = list(words)
    while True:
        words[rng.randrange(len(words))] = f"n{rng.getrandbits(30)}"
        if jaccard(own, plain_shingles(" ".join(words))) < similarity:
            return last
        last = list(words)


def cut_off(rng, words, similarity):
    """`words` without the end, so that the similarity to them is just above."""
    n = len(words) - 4
    return words[: 4 + int(np.ceil(similarity * n))]


def body(rng, n):
    return [f"w{rng.getrandbits(14)}" for _ in range(n)]


@pytest.mark.parametrize("change", [vary, cut_off])
def test_recall_at_the_threshold(spark, change):
    """Of pairs just above a similarity of 0.8 at least 0.9 are found, among thousands of other texts; of no others any."""
    rng = random.Random(1)
    rows = []
    for k in range(300):
        words = body(rng, rng.choice([60, 120, 300, 800]))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(change(rng, words, 0.8)))]
    for k in range(100):  # just below
        words = body(rng, 200)
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(vary(rng, words, 0.7)[:190]))]
    rows += [(5000 + k, " ".join(body(rng, 80))) for k in range(2000)]
    sets = {i: plain_shingles(t) for i, t in rows}
    got = {r.doc_id: r["first"].doc_id for r in N.near_copy_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(300))
    assert found >= 0.9 * 300
    for i, first in got.items():
        if first != i:
            assert jaccard(sets[i], sets[first]) >= 0.8


def test_links_of_a_whole_table(spark):
    """Of all links of a given table at least 0.9 are found, and no others: each component is one of the plain ones or a part."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, links = plain_first(rows)
    at = {i: k for k, (i, _) in enumerate(rows)}
    got = {r.doc_id: r["first"].doc_id for r in N.near_copy_components(docs).collect()}
    assert all(want[at[i]] == want[at[f]] for i, f in got.items())
    assert len(links) > 20
    assert sum(got[rows[a][0]] == got[rows[b][0]] for a, b in links) >= 0.9 * len(links)
    kept = N.one_of_each(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


@pytest.mark.parametrize("chunk,call_bytes", [(4096, 8 << 20), (16, 8 << 20), (64, 4000)])
def test_large_groups_in_pieces(spark, chunk, call_bytes):
    """A star of near copies whose pairs among each other are below the threshold, a chain, and copies."""
    rng = random.Random(2)
    centre = body(rng, 200)
    rows = [(100 + k, " ".join(vary(rng, centre, 0.85))) for k in range(150)] + [(999, " ".join(centre))]
    chain = body(rng, 150)
    for k in range(30):
        chain = vary(rng, chain, 0.9)
        rows.append((2000 + k, " ".join(chain)))
    rows += [(3000 + k, " ".join(centre)) for k in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r["first"].doc_id for r in N.near_copy_components(docs, chunk=chunk, call_bytes=call_bytes).collect()}
    want, _ = plain_first(rows)
    groups = defaultdict(set)
    for (i, _), c in zip(rows, want):
        groups[c].add(i)
    found = defaultdict(set)
    for i, c in got.items():
        found[c].add(i)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, groups.values()))


def test_shingles_and_similarities():
    texts = ["", " \n", "one", "One two", "a b c d e", "a b c d e a b c d e a", "É x\xa0y z  A\tB c", "w " * 5000]
    for t in texts:
        assert len(N.shingles(t.encode())) == len(plain_shingles(t))
    rng = random.Random(3)
    words = [f"v{k}" for k in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    s = N.Shingled([N.shingles(t.encode()) for t in texts])
    plain = [plain_shingles(t) for t in texts]
    for threshold in (0.05, 0.3, 0.8):
        for x in range(60):
            others = np.array([y for y in range(60) if y != x])
            assert s.similar(x, others, threshold).tolist() == [jaccard(plain[x], plain[y]) >= threshold for y in others]


def test_one_of_each(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(5, text, "a", "b"), (3, text, None, "b"), (3, text, None, "b"), (9, text + " more", "a", "b"),
            (7, "another text " + " ".join(f"z{k}" for k in range(80)), "a", "b"), (None, text, "a", "b"),
            (8, None, "a", "b"), (6, "", "a", "b"), (6, "", "a", "b"), (10, "  ", "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = N.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7]


def test_one_of_each_tells_rows_apart(spark):
    """Several rows without an id, an id with a copied text and one of its own, and many repeats of one row."""
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcd")
    rows = [(1, a, "p", "q"), (None, a, "p", "q"), (None, b, "p", "q"), (None, b, "p", "r"), (None, c, "p", "q"),
            (2, a, "p", "q"), (2, d, "p", "q"), (None, d + " more", "p", "q")] + [(4, "again", "p", "q")] * 500
    kept = N.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id or 0, r.text) for r in kept) == Counter([(1, a), (0, b), (0, c), (2, d), (4, "again")])


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert N.one_of_each(docs).count() == 0
    names = "node key text_hash first _id _hash _stays _again f0 bytes call p q pieces size".split()
    wide = spark.createDataFrame([(1, "a b c", *["x"] * len(names))], f"doc_id int, text string, {', '.join(f'{n} string' for n in names)}")
    kept = N.one_of_each(wide)
    assert kept.columns == wide.columns and kept.count() == 1
