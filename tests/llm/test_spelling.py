"""Spelling variants: gram bounds and near words against brute force, the query on a whole table, odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import spelling
from tallyspark.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string"


def _near(a, b):
    """Whether one inserted, deleted or replaced code point makes the two equal."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _pairs(words):
    """Near words by what is left when a code point is taken out."""
    by_rest = defaultdict(set)
    for w in words:
        by_rest[w].add(w)
        for i in range(len(w)):
            by_rest[w[:i] + w[i + 1 :]].add(w)
    found = set()
    for same in by_rest.values():
        if len(same) > 1:
            same = sorted(same)
            found |= {(a, b) for k, a in enumerate(same) for b in same[k + 1 :] if _near(a, b)}
    return found


def _words(rows, min_count=5):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= min_count}


def _want(rows):
    n = _words(rows)
    near = defaultdict(list)
    for a, b in _pairs(n):
        near[a].append(b)
        near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x))
        if n[best] >= 5 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out, key=lambda r: r[0])


def _edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield i, word[:i] + c + word[i:]
        if i < len(word):
            yield i, word[:i] + word[i + 1 :]
            for c in letters:
                yield i, word[:i] + c + word[i + 1 :]


@pytest.mark.parametrize("seed,max_gram,letters", [(0, 3, "ab"), (1, 4, "ab"), (2, 3, "abc"), (3, 5, "abc"), (4, 4, "abcd")])
def test_bound_holds_for_every_edit(seed, max_gram, letters):
    """No edit takes away more of a word's grams than the bound, whatever the word becomes."""
    rng = random.Random(seed)
    sample = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 10))) for _ in range(60)]
    count = Counter(w[i : i + k] for w in sample for k in range(2, max_gram + 1) for i in range(len(w) - k + 1))
    grams = {g for g in count if all(count[g[:k]] > rng.choice([3, 8, 20]) for k in range(2, len(g)))}
    grams = {g for g in grams if all(g[:k] in grams for k in range(2, len(g)))}
    d = spelling.GramDictionary(grams, 2, max_gram)
    tight = 0
    for word in sample[:25]:
        own = d.decompose(word)
        bound, worst = d.affected(word, own), 0
        for at, other in _edits(word, letters):
            if other == word:
                continue
            shift = len(other) - len(word)
            theirs = {(s, e, other[s:e]) for s, e in d.decompose(other)}
            lost = sum((s, e, word[s:e]) not in theirs and (s + shift, e + shift, word[s:e]) not in theirs for s, e in own)
            worst = max(worst, lost)
        assert worst <= bound
        tight += worst == bound
    assert tight  # the bound is reached


@pytest.mark.parametrize("max_gram,frequent", [(3, 0.001), (4, 0.001), (5, 0.01), (2, 0.1), (6, 0.0001)])
def test_near_pairs_against_brute_force(spark, max_gram, frequent):
    """Also for settings under which many words have no gram that is certainly shared."""
    rng = random.Random(max_gram)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(700)}
    words |= {"".join(rng.choice(["the", "in", "ou", "ble", "ÿ"]) for _ in range(rng.randint(3, 6))) for _ in range(500)}
    words = sorted(w for w in words if len(w) >= 6)
    table = spark.createDataFrame([(w, len(w)) for w in words], "word string, n long")
    grams = spelling.gram_dictionary(table, max_gram=max_gram, frequent=frequent)
    rows = spelling.index_rows(table, grams).collect()
    assert {r.word for r in rows} == set(words)
    if max_gram >= 5:
        assert any(r.keep == 0 for r in rows)  # the halves are needed
    got = spelling.near_pairs(table, grams).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(_pairs(words))
    assert all((r.n_a, r.n_b) == (len(r.a), len(r.b)) for r in got)


def test_query_on_a_whole_table(spark):
    got = sorted(map(tuple, QUERIES["op13_spelling_variants"](spark, SF_DIR).collect()), key=lambda r: r[0])
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    want = _want(rows)
    assert got == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[2] not in (r[0], r[1]) for r in want)


def test_odd_rows(spark):
    rows = [(None, "Kitten kitten KITTEN kitten kitten")] * 30 + [(None, "kittens " * 5), (None, "kittenss " * 5), (None, "mittens " * 6)]
    rows += [(None, None), (1, ""), (2, " 12 ab "), (None, "x" * 4000 + " "), (None, "ÀÉÎÕÜŸ ×÷×÷×÷ " * 5), (None, "straße " * 7 + "strasse " * 40)]
    rows += [(None, "x" * 4000 + " ")] * 4 + [(None, "x" * 4001 + " ")] * 30 + [(7, "repeated " * 9)] * 3
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], f"{SCHEMA}, word string, n int").repartition(4)
    got = sorted(map(tuple, spelling.spelling_variants(docs).collect()), key=lambda r: r[0])
    assert got == _want(rows)
    assert ("kittens", "kitten", "kitten", 5, 3, 150) in got
    assert spelling.spelling_variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_chains_and_ties(spark):
    count = {"abcdef": 5, "abcdeg": 25, "abcdgg": 125, "abcggg": 625, "abgggg": 3125, "zbcdef": 25}
    rows = [(None, f"{w} " * n) for w, n in count.items()]
    got = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got["abcdef"].form == "abcdeg"  # as frequent as zbcdef, and before it
    assert {r.root for w, r in got.items() if w != "zbcdef"} == {"abgggg"}
    assert (got["zbcdef"].form, got["zbcdef"].root, got["zbcdef"].n_near) == (None, "zbcdef", 1)
