"""Toxicity: held-out accuracy, the risk estimator, and odd input."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import toxicity as X

DOCS = "doc_id long, text string, score double, held_out string"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = X.toxicity(docs, labels)
    assert got.count() == docs.count()
    n = {
        (r.toxic, r.predicted): r["count"]
        for r in got.where("held_out").join(labels, "doc_id").groupBy("toxic", "predicted").count().collect()
    }
    # Some labels are flipped at random: a share that no text tells.
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]
    assert n[1, 1] >= 0.75 * (n[1, 1] + n.get((1, 0), 0))


def test_non_negative_risk_separates_without_negatives():
    rng = np.random.default_rng(0)

    def doc(toxic):
        common = rng.choice(50, 8, replace=False) + 5
        return np.append(common, rng.choice(5, 2, replace=False)) if toxic else common

    positive = [doc(True) for _ in range(300)]
    unlabelled = [doc(rng.random() < 0.2) for _ in range(3000)]
    w, b = X.nn_pu_fit(positive, unlabelled, 55, 0.2)
    g = lambda d: w[d].sum() + b
    assert np.mean([g(doc(True)) > 0 for _ in range(500)]) > 0.95
    assert np.mean([g(doc(False)) < 0 for _ in range(500)]) > 0.95


def _tables(spark):
    rows = [(k, ("idiot scum" if k % 3 == 0 else "a fine day") + f" word{k}", 0.0, None) for k in range(200)]
    rows += [(None, "idiot scum", None, "x"), (1000, None, 1.0, "x"), (1001, "", 1.0, "x"), (1002, "IDIOT, Scum! " * 20000, 1.0, "x"),
             (1, "a fine day word1", 0.0, None)]
    labels = [(k, None, int(k % 3 == 0)) for k in range(120)] + [(3, 1, None), (None, 0, 1), (4, 0, 0)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)


def test_odd_rows(spark):
    docs, labels = _tables(spark)
    got = X.toxicity(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.predicted for r in rows}
    assert by_id[1002] == by_id[None] == 1 and by_id[1000] == by_id[1001] == 0
    assert all(by_id[k] == (k % 3 == 0) for k in range(200))
    kept = X.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([k for k in range(200) if k % 3] + [1, 1000, 1001])


def test_held_out_labels_are_not_read(spark):
    docs, labels = _tables(spark)
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = {(r.doc_id, r.score) for r in X.toxicity(docs, labels).collect()}
    assert one == {(r.doc_id, r.score) for r in X.toxicity(docs, flipped).collect()}


def test_nothing_to_learn(spark):
    docs, labels = _tables(spark)
    assert X.toxicity(docs.limit(0), labels).count() == 0
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(0))):
        assert {r.score for r in X.toxicity(docs, none).collect()} == {0.0}


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    """A toxic id that 100,000 rows repeat, and an id with many texts: the sample holds no more rows than its bounds."""
    once, many = [k for k in range(50) if zlib.crc32(str(k).encode()) % 5][:2]
    rows = spark.range(100_000).select(F.lit(once).cast("long").alias("doc_id"), F.lit("idiot scum").alias("text"))
    rows = rows.union(spark.range(500).selectExpr(f"{many}L", "concat('idiot scum ', id)"))
    rows = rows.union(spark.range(2000).selectExpr("id + 100", "concat('a fine day word', id)"))
    labels = spark.createDataFrame([(once, 1), (many, 1), *((k, 0) for k in range(100, 400))], "doc_id long, toxic int")
    sizes = []
    fit = X.nn_pu_fit
    monkeypatch.setattr(X, "nn_pu_fit", lambda p, u, *a, **b: sizes.append((len(p), len(u))) or fit(p, u, *a, **b))
    model = X.train(rows, labels, max_positives=40, max_unlabelled=300)
    assert sizes and sizes[0][0] == 40 and 250 < sizes[0][1] <= 300
    assert model.score(b"idiot scum") > model.score(b"a fine day word7")


def test_no_feature_is_left_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    assert 10 < len(X.train(docs, labels).weights) < X.MAX_FEATURES // 2
