"""Embedding near-duplicates against brute force."""

import numpy as np

from tallyspark.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string"


def brute(ids, vecs, threshold=0.95):
    """n_links and component by vec_id, for usable vectors."""
    x = np.array(vecs, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= threshold
    np.fill_diagonal(links, False)
    label = np.array(ids)
    while True:
        low = np.where(links, label[None, :], label[:, None]).min(axis=1)
        low = np.minimum(low, label)
        if (low == label).all():
            return dict(zip(ids, zip(links.sum(axis=1).tolist(), label.tolist())))
        label = low


def test_whole_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = vectors.collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    report = {}
    got = N.near_duplicates(vectors, report=report).collect()
    assert report["recall"] >= 0.9 and len(got) == len(rows)
    found, true = sum(r.n_links for r in got), sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got) and found >= 0.9 * true
    assert np.mean([r.component_id == want[r.vec_id][1] for r in got]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_large_groups_and_odd_rows(spark):
    """Groups larger than lists, cells and pieces; copies; unusable vectors."""
    rng = np.random.default_rng(4)
    vecs = [rng.standard_normal(16) for _ in range(300)]
    centre = rng.standard_normal(16)
    vecs += [centre + 0.02 * rng.standard_normal(16) for _ in range(1300)]
    for _ in range(20):
        c = rng.standard_normal(16)
        vecs += [c + 0.05 * rng.standard_normal(16) for _ in range(15)]
    copy = rng.standard_normal(16)
    vecs += [copy] * 400 + [copy * 2.0] * 3
    vecs = [np.asarray(v, np.float32) for v in vecs]
    ids = (rng.permutation(len(vecs)) + 10).tolist()
    want = brute(ids, vecs)
    rows = [(i, [float(x) for x in v], 0, "x", "y") for i, v in zip(ids, vecs)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    rows += [(k, e, None, "x", "y") for k, e in enumerate(odd)]
    rows += [(8, [1.0, 2.0, 3.0], 1, "x", "y"), (9, [1.0, 2.0, 3.0], 1, "x", "y"), (9, [1.0, 2.0, 3.0], 1, "x", "y"), (None, [-3.0, 1.0, 0.0], 1, "x", "y")]
    report = {}
    got = N.near_duplicates(spark.createDataFrame(rows, SCHEMA), report=report).collect()
    by_id = {r.vec_id: r for r in got}
    assert len(got) == len(rows) and report["recall"] >= 0.9
    for k in range(len(odd)):
        assert (by_id[k].n_links, by_id[k].component_id, by_id[k].kept) == (0, k, True)
    assert by_id[8].n_links == by_id[9].n_links == 2 and by_id[9].component_id == 8
    assert (by_id[None].n_links, by_id[None].component_id, by_id[None].kept) == (0, None, True)
    assert {i: (by_id[i].n_links, by_id[i].component_id) for i in ids} == want


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def hot_group_and_pairs(n_hot=1000, n_pairs=1000, dim=48):
    """A third of the vectors around one centre, the others in pairs that are alone with each other."""
    rng = np.random.default_rng(8)
    vecs = list(rng.standard_normal(dim) + 0.02 * rng.standard_normal((n_hot, dim)))
    for _ in range(n_pairs):
        x = rng.standard_normal(dim)
        vecs += [x, x + 0.22 * rng.standard_normal(dim)]
    return [[float(x) for x in np.asarray(v, np.float32)] for v in vecs]


def test_a_hot_group_hides_no_lost_pairs(spark):
    vecs = hot_group_and_pairs(300, 300)
    classes, _ = N.vector_classes(spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>"))
    want = brute(range(len(vecs)), vecs)
    first = {r["c"]: r["first"] for r in classes.collect()}
    found = [(c, want[i][0], want[i][0]) for c, i in first.items() if i < 300]
    linked = spark.createDataFrame(found, "c long, linked long, others long")
    recall, few = N.audited_recall(classes, linked, 0.95)
    assert recall < 0.6 and few == 0


def test_pairs_meet_however_many_cells_there_are(spark, monkeypatch):
    """Cells as small, against the table, as those of a million vectors."""
    for n in (10**2, 10**4, 10**6, 10**7):
        same = (1 - np.arccos(0.95) / np.pi) ** N.cell_bits(n)
        assert 1 - (1 - same) ** N.trees_needed(n, 0.95) >= 0.995
    monkeypatch.setattr(N, "CELL", 4)
    vecs = hot_group_and_pairs(0, 1500)
    report = {}
    docs = spark.createDataFrame(list(enumerate(vecs)), "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in N.near_duplicates(docs, report=report).collect()}
    want = {i: m for i, (m, _) in brute(range(len(vecs)), vecs).items()}
    assert report["searches"] == 1 and sum(got.values()) >= 0.98 * sum(want.values())


def test_searches_add_up_and_end_in_a_comparison_of_all(spark, monkeypatch):
    """Each search finds a part of the pairs only; then none finds any."""
    vecs = hot_group_and_pairs(0, 60) + hot_group_and_pairs(700, 0)
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>")
    want = brute(range(len(vecs)), vecs)
    real, turns = N.neighbour_lists, []

    def part(classes, *args):
        turns.append(len(turns))
        lists = real(classes, *args)
        odd = classes.select(N.F.col("c").alias("u"), (N.F.col("first") < 120).alias("pair"), (N.F.floor(N.F.col("first") / 2) % 2).alias("odd"))
        return lists.join(odd, "u").where(~N.F.col("pair") | (N.F.col("odd") == turns[-1] % 2)).select("u", "v", "sim")

    monkeypatch.setattr(N, "neighbour_lists", part)
    report = {}
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.near_duplicates(docs, report=report).collect()}
    assert got == want and report["searches"] == 2
    monkeypatch.setattr(N, "neighbour_lists", lambda *args: real(*args).limit(0))
    got = {r.vec_id: (r.n_links, r.component_id) for r in N.near_duplicates(docs, report=report).collect()}
    assert got == want and report["searches"] == 3 and report["recall"] == 1
