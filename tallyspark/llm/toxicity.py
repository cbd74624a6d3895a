"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017).

Confirmed toxic documents are the positives, other texts are unlabelled. A
linear classifier over word features is fitted in numpy on a bounded sample;
the risk corrects for the toxic documents among the unlabelled ones by the
class prior, and its negative part is kept from going below zero. Words are
counted and texts scored by Spark over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import free_prefix, slices, written

#: Bounds of the training sample, in different rows.
MAX_POSITIVES = 4000
MAX_UNLABELLED = 20000
MIN_DOCUMENTS = 5
#: A word is a feature if its share differs between the two sides by this many standard errors. What differs less
#: carries no signal that a sample of this size could show: by chance 6 words of 100,000 differ by more.
MIN_ERRORS = 4.0
#: Bound of the features. Some hundred words pass `MIN_ERRORS` on the given tables (tested), so that it leaves none of
#: them out; it only keeps the model small where a sample should hold very many. The least evident would go first.
MAX_FEATURES = 1 << 16
FOLDS = 5

_TO_SPACE = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))


def features(text: bytes) -> set[bytes]:
    """Distinct lower-cased words of a UTF-8 text; ASCII marks end a word."""
    return set(text.lower().translate(_TO_SPACE).split())


@dataclass(frozen=True)
class Model:
    """Weights of words, and a bias; without positives every score is 0."""

    weights: dict[bytes, float] = field(default_factory=dict)
    bias: float = -math.inf
    prior: float = 0.0

    def score(self, text: bytes) -> float:
        get = self.weights.get
        g = self.bias + sum([get(w, 0.0) for w in features(text)])
        return 1 / (1 + math.exp(-g)) if g > -700 else 0.0


def nn_pu_fit(
    positive: list[np.ndarray],
    unlabelled: list[np.ndarray],
    n_features: int,
    prior: float,
    steps: int = 400,
    rate: float = 0.05,
    decay: float = 1e-4,
    seed: int = 42,
) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the non-negative risk, by Adam on batches.

    With the logistic loss l, the risk is prior * E_p[l(g)] + max(0, E_u[l(-g)]
    - prior * E_p[l(-g)]). Where the second part is negative, the step goes
    against it, as the paper does.
    """
    rng = np.random.default_rng(seed)
    theta = np.zeros(n_features + 1)  # the bias last
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def rows(sample: list[np.ndarray], size: int):
        chosen = sample if len(sample) <= size else [sample[i] for i in rng.choice(len(sample), size, replace=False)]
        idx = np.concatenate([np.append(r, n_features) for r in chosen]).astype(np.int64)
        return idx, np.array([len(r) + 1 for r in chosen])

    def scores(idx, sizes):
        return np.add.reduceat(theta[idx], np.cumsum(sizes) - sizes)

    def gradient(idx, sizes, slope):
        return np.bincount(idx, np.repeat(slope / len(sizes), sizes), n_features + 1)

    for step in range(1, steps + 1):
        p, u = rows(positive, 1000), rows(unlabelled, 5000)
        gp, gu = scores(*p), scores(*u)
        hp, hu = 1 / (1 + np.exp(-np.clip(gp, -30, 30))), 1 / (1 + np.exp(-np.clip(gu, -30, 30)))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        d_negative = gradient(*u, hu) - prior * gradient(*p, hp)
        d_positive = prior * gradient(*p, hp - 1)
        d = d_positive + d_negative if negative >= 0 else -d_negative
        d[:-1] += decay * theta[:-1]
        m = 0.9 * m + 0.1 * d
        v = 0.999 * v + 0.001 * d * d
        theta -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-1], float(theta[-1])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from; a null id counts as the text ""."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_positives: int = MAX_POSITIVES,
    max_unlabelled: int = MAX_UNLABELLED,
    max_features: int = MAX_FEATURES,
) -> Model:
    """A model from `docs` (`doc_id`, `text`) and the labels (`doc_id`, `toxic`) that are not held out.

    The class prior is the toxic share of these labels. At most
    `max_positives` toxic rows and `max_unlabelled` others enter, chosen by a
    hash of their id and text; rows that repeat are one. Null labels are
    ignored; without a toxic label, or with empty tables, every score is 0.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_toxic, n_known = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    if not n_toxic:
        return Model()
    prior = n_toxic / n_known
    chosen = (
        known.where("toxic = 1")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_positives)
        .select(F.col("doc_id").alias("_id"))
    )
    learn = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(
        ~held_out(F.col("doc_id"))
    )
    learn = learn.withColumn("hash", F.xxhash64("text"))
    scale = 1 << 40
    # An id that many rows repeat counts once.
    ids, nameless = docs.agg(F.approx_count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    share = min(1.0, 1.2 * max_unlabelled / max(1, (ids + nameless) * (FOLDS - 1) / FOLDS))
    # Rows are chosen by their id and the hash of their text; rows that repeat are one. No text moves yet.
    some = F.pmod(F.xxhash64("doc_id", "hash", F.lit(1)), F.lit(scale)) < int(share * scale)
    marked = learn.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", "hash", some.alias("some"), F.col("_id").isNotNull().alias("toxic")
    )
    marked = written(marked.where("some or toxic").distinct(), "toxicity-rows")
    order = F.xxhash64("hash", "doc_id")

    def picked(which: str, most: int, positive: int) -> DataFrame:
        rows = marked.where(which).orderBy(order, "hash", "doc_id").limit(most)
        return rows.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.lit(positive).alias("positive"))

    picks = written(picked("some", max_unlabelled, 0).union(picked("toxic", max_positives, 1)), "toxicity-picks")
    same = learn["doc_id"].eqNullSafe(picks["_id"]) & (learn["hash"] == picks["_hash"])
    found = learn.join(F.broadcast(picks), same).select("_id", "_hash", "positive", "text")  # as many as the bounds
    sample = found.dropDuplicates(["_id", "_hash", "positive"]).select("text", "positive")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [sorted(features(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.binary()))], ["positive", "words"])

    sample = written(sample.mapInArrow(words, "positive int, words array<binary>"), "toxicity-sample")
    n_p, n = sample.agg(F.sum("positive"), F.count("*")).first()
    if not n_p or n == n_p:
        return Model()
    # The words whose share differs most between the two sides, by its standard error.
    differs = F.col("p") / n_p - (F.col("n") - F.col("p")) / (n - n_p)
    pooled = F.col("n") / n
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / (n - n_p)))
    best = (
        sample.select("positive", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"), F.sum("positive").alias("p"))
        .where((F.col("n") >= MIN_DOCUMENTS) & (F.abs(differs) >= MIN_ERRORS * error))
        .orderBy(F.try_divide(F.abs(differs), error).desc_nulls_last(), "word")
        .limit(max_features)
    )
    vocabulary = sorted(bytes(r.word) for r in best.collect())  # at most max_features
    place = {w: i for i, w in enumerate(vocabulary)}

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [
                np.array([place[w] for w in ws if w in place], "<u4").tobytes() for ws in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["positive", "at"])

    rows = sample.mapInArrow(indexed, "positive int, at binary").collect()  # the bounded sample
    rows = sorted((r.positive, bytes(r.at)) for r in rows)
    sides = [[np.frombuffer(at, "<u4") for kind, at in rows if kind == side] for side in (1, 0)]
    weights, bias = nn_pu_fit(*sides, len(vocabulary), prior)
    return Model({w: float(x) for w, x in zip(vocabulary, weights) if x}, bias, prior)


def scored(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """`docs` and the column `name`, the score of the whole text; a null text counts as empty.

    The model, which tasks receive whole, is bounded by its features.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores = [
                model.score(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(at)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name]
            )

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """(`doc_id`, `held_out`, `score`, `predicted`) for every row of `docs` (`doc_id`, `text`).

    Null and empty texts get the score of a text without words. Repeated rows
    give a row each. An empty table gives an empty result. Other columns are
    ignored, the labels of held-out rows too.
    """
    model = train(docs, labels, **bounds)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of `docs` that score below 0.5, with all their columns.

    Null and empty texts are scored as texts without words; a score of just
    0.5 goes. Rows that repeat stay or go together. An empty table gives an
    empty result.
    """
    model = train(docs, labels, **bounds)
    score = free_prefix(docs, "_score")
    return scored(docs, model, score).where(F.col(score) < 0.5).drop(score)
