"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

They are found by SimHash with a wide radius. A fingerprint has 256 bits, made
from the distinct shingles. The references of its pivot table differ from a
base reference in one bit each, so that a distance, less the one to the base,
tells whether that bit agrees. Equal distances to the references of one random
choice are a key, and there are so many choices that two texts at the
threshold share a key with the chance `RECALL`. What the bits leave under a
key, a forest connects to clusters. The texts of a cluster are compared in
place by their shingles; pairs never leave a task, links that connect the same
texts do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, free_prefix, slices, written
from tallyspark.llm.components import components
from tallyspark.llm.simhash import CHUNK, SEED, dealt

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BITS = 256
#: The chance that two texts at the threshold share a key.
RECALL = 0.98
#: Bits in which fingerprints of a cluster may differ, in standard deviations above the mean at the threshold.
DEVIATIONS = 3.0
#: Bytes of the texts of a cluster that one side of a call holds; larger clusters are split.
CALL_BYTES = 8 << 20


def shingles(text: bytes) -> np.ndarray:
    """Hashes of the distinct shingles of a text in UTF-8, ascending: words as in `simhash.fingerprint`."""
    w = text.lower().split()
    if not w:
        return np.empty(0, np.uint64)
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    n = min(SHINGLE_WORDS, len(w))
    digest = xxhash.xxh64_intdigest
    pairs = zip((end - size)[: len(w) - n + 1].tolist(), end[n - 1 :].tolist())
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in pairs], np.uint64))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four words: a bit is 1 if set in over half the distinct shingles."""
    out = np.zeros(BITS // 64, np.uint64)
    for k in range(len(out)):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 14):  # bounded, however long the text
            h = hashes[at : at + (1 << 14)]
            if k:  # further words: the hash mixed with a constant of the word's own
                h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(29)
            part = h.astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]
    return out


def differing_share(similarity: float) -> float:
    """The expected share of bits in which two texts of equally many shingles differ at this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan(texts: int, threshold: float = THRESHOLD) -> tuple[int, int, int]:
    """Bits of a key, number of keys, and largest difference in bits.

    A key has more bits the more texts there are, so that about eight
    unrelated texts share one; the number of keys follows from `RECALL`.
    """
    share = differing_share(threshold)
    width = max(8, math.ceil(math.log2(max(texts, 2))) - 3)
    keys = math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - share) ** width))
    radius = BITS * share + DEVIATIONS * math.sqrt(BITS * share * (1 - share))
    return width, keys, math.ceil(radius)


def references(seed: int = SEED) -> np.ndarray:
    """The base reference, then one for each bit that differs from it there; four words a row."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.tile(base, (BITS + 1, 1))
    bit = np.arange(BITS)
    out[1 + bit, bit // 64] ^= np.uint64(1) << (bit % 64).astype(np.uint64)
    return out


def pivot_keys(fps: np.ndarray, width: int, keys: int, seed: int = SEED) -> np.ndarray:
    """Per fingerprint (four words a row) its keys: hashes of the distances to `width` references, for each choice of them."""
    refs = references(seed)
    table = sum(np.bitwise_count(fps[:, None, k] ^ refs[None, :, k]).astype(np.int16) for k in range(fps.shape[1]))
    inside = (table[:, 1:] - table[:, :1]).astype(np.int64)
    rng = np.random.default_rng(seed + 1)
    out = np.empty((len(fps), keys), np.int64)
    for k in range(keys):
        some = rng.choice(BITS, width, replace=False)
        weight = rng.integers(1, 1 << 62, width, dtype=np.int64) | 1
        out[:, k] = (inside[:, some] * weight).sum(axis=1) ^ rng.integers(0, 1 << 62)  # wraps around, as hashes do
    return out


def _far(fps: np.ndarray, x: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[others] ^ fps[x]).sum(axis=1, dtype=np.int64)


def forest(n: int, near) -> list[tuple[int, int]]:
    """Links of a breadth-first forest of `n` points; `near(x, others)` says which of the others link to x."""
    rest, links = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = near(x, rest)
            if hit.any():
                links += [(x, int(y)) for y in rest[hit]]
                queue += rest[hit].tolist()
                rest = rest[~hit]
    return links


class Shingled:
    """The shingle sets of a call's texts, as numbers: similarities of one text with many at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.first = np.cumsum(self.size) - self.size
        flat = np.concatenate([*sets, np.empty(0, np.uint64)])
        self.flat = np.unique(flat, return_inverse=True)[1]
        self.mark = np.zeros(len(flat) + 1, bool)

    def similar(self, x: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of the texts `others`, none empty, have at least this Jaccard similarity with text `x`."""
        own = self.flat[self.first[x] : self.first[x] + self.size[x]]
        low = np.minimum(self.size[others], len(own))
        out = low >= threshold * np.maximum(self.size[others], len(own))
        some = others[out]
        if len(some):
            self.mark[own] = True
            size = self.size[some]
            begin = np.cumsum(size) - size
            at = np.repeat(self.first[some] - begin, size) + np.arange(size.sum())
            both = np.add.reduceat(self.mark[self.flat[at]].astype(np.int64), begin)
            self.mark[own] = False
            out[out] = both >= threshold * (size + len(own) - both)
        return out


def _words(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([frame[f"f{k}"].to_numpy() for k in range(BITS // 64)], axis=1).view(np.uint64)


def _groups(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the runs of equal rows of a sorted `key` with two or more."""
    edges = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)]):
        if b - a > 1:
            yield a, b


_F = [f"f{k}" for k in range(BITS // 64)]
_ROW = "struct(doc_id is null as nameless, doc_id, text_hash)"


def _nodes(docs: DataFrame) -> DataFrame:
    """(`doc_id`, `text_hash`, `node`, the fingerprint's words, `bytes`) per row; `node` names the set of shingles, 0 the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts, hashes = batch.columns
            found = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in texts]
            sets = [shingles(t) for t in found]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            fps = np.stack([wide_fingerprint(s) for s in sets]).view(np.int64) if sets else np.empty((0, len(_F)), np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids, hashes, pa.array(node), *(pa.array(np.ascontiguousarray(c)) for c in fps.T), pa.array([len(t) for t in found], pa.int64())],
                ["doc_id", "text_hash", "node", *_F, "bytes"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_hash"))
    return source.mapInArrow(run, f"doc_id long, text_hash long, node long, {', '.join(f'{c} long' for c in _F)}, bytes long")


def _clusters(nodes: DataFrame, n: int, threshold: float, chunk: int) -> DataFrame:
    """(`node`, `component`): nodes that chains of fingerprints within the radius, each under one key, connect."""
    width, keys, radius = plan(n, threshold)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                fps = np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns[1:]], axis=1).view(np.uint64)
                found = pivot_keys(fps, width, keys)
                again = pa.array(np.repeat(np.arange(part.num_rows), keys))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *(c.take(again) for c in part.columns)], ["key", "node", *_F])

    columns = ", ".join(f"{c} long" for c in ("key", "node", *_F))
    rows = nodes.select("node", *_F).mapInArrow(keyed, columns)
    rows = written(rows, "near-copies-keys")
    # Only keys with more than a chunk are counted into a table; few, so that rows need not be shuffled to learn of them.
    large = rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    large = written(large, "near-copies-large").withColumnRenamed("key", "_key")
    sized = rows.join(large, rows["key"] == large["_key"], "left").drop("_key")
    pieces = F.ceil(F.coalesce("size", F.lit(1)) / chunk)

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "p", "q"], kind="stable")
        node, fps = frame["node"].to_numpy(), _words(frame)
        a, b = [], []
        for x, y in _groups(frame[["key", "p", "q"]].to_numpy()):
            some = fps[x:y]
            for i, j in forest(y - x, lambda k, others, some=some: _far(some, k, others) <= radius):
                a.append(node[x + i])
                b.append(node[x + j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    calls = max(64, n * keys // 50_000)
    links = dealt(sized, "key", "node", pieces, calls).groupBy("call").applyInPandas(link, "a long, b long")
    return components(links.distinct())


def near_copy_components(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, call_bytes: int = CALL_BYTES) -> DataFrame:
    """(`doc_id`, `text_hash`, `first`) per row of `docs`: `first` is the first row of its component.

    A row is (`nameless`, `doc_id`, `text_hash`), in this order, so that rows
    without an id come last. Texts whose shingles are the same are in one
    component, null and blank ones among them; texts of fewer than five words
    have their words as one shingle.
    """
    rows = written(_nodes(docs), "near-copies-rows")
    nodes = rows.groupBy("node", *_F).agg(F.min(F.expr(_ROW)).alias("first"), F.max("bytes").alias("bytes"))
    nodes = cut(nodes)
    clusters = cut(_clusters(nodes.where("node <> 0"), nodes.count(), threshold, chunk))
    members = clusters.join(nodes, "node")
    sizes = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("bytes").alias("total"))
    members = members.join(cut(sizes), "component")
    pieces = F.ceil(F.greatest(F.col("size") / chunk, F.col("total") / call_bytes))
    # One text stands for all with its shingles. Written, so that Spark broadcasts a small table and bloom-filters with a large one.
    members = written(members.select("component", "node", "first", "bytes", pieces.alias("pieces")), "near-copies-members")
    total = members.agg(F.sum("bytes")).first()[0] or 0
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    same = hashed["doc_id"].eqNullSafe(members["first.doc_id"]) & (hashed["text_hash"] == members["first.text_hash"])
    texts = hashed.join(members, same).select("component", "node", F.col("text").cast("binary").alias("text"), "pieces")
    radius = plan(2, threshold)[2]

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        # A text that several rows have stands there several times.
        frame = frame.sort_values(["component", "p", "q", "node"], kind="stable").drop_duplicates(["component", "p", "q", "node"])
        node = frame["node"].to_numpy()
        a, b = [], []
        for x, y in _groups(frame[["component", "p", "q"]].to_numpy()):
            sets = [shingles(t) for t in frame["text"].iloc[x:y]]
            fps = np.stack([wide_fingerprint(s) for s in sets])
            texts = Shingled(sets)

            def near(k: int, others: np.ndarray) -> np.ndarray:
                out = _far(fps, k, others) <= radius
                out[out] = texts.similar(k, others[out], threshold)
                return out

            for i, j in forest(y - x, near):
                a.append(node[x + i])
                b.append(node[x + j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    calls = max(64, total // (8 << 20))
    links = dealt(texts, "component", "node", F.col("pieces"), calls).groupBy("call").applyInPandas(link, "a long, b long")
    found = components(links.distinct()).withColumnRenamed("node", "_node")
    joined = nodes.join(found, nodes["node"] == found["_node"], "left")
    joined = cut(joined.select("node", "first", F.coalesce("component", "node").alias("component")))
    firsts = cut(joined.groupBy("component").agg(F.min("first").alias("first")))
    of = cut(joined.drop("first").join(firsts, "component").select(F.col("node").alias("_node"), "first"))
    return rows.join(of, rows["node"] == of["_node"]).select("doc_id", "text_hash", "first")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK, call_bytes: int = CALL_BYTES) -> DataFrame:
    """One row of `docs` for each component of near copies: the first by `doc_id`, nulls last, then by the hash of the text.

    Of rows that repeat, with the same `doc_id` (or none) and text, one stays.
    Null, empty and blank texts are copies of each other. Other columns stay as
    they are; where repeated rows differ in them, any one row is taken. An
    empty table gives an empty result.
    """
    rows = near_copy_components(docs, threshold, chunk, call_bytes)
    here = F.expr(_ROW)
    keys = rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("first").alias("first"))
    keys = written(keys.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), here.eqNullSafe(F.col("first")).alias("_stays"), (F.col("n") > 1).alias("_again")), "near-copies-keys")

    def same(other: DataFrame) -> Column:
        return docs["doc_id"].cast("long").eqNullSafe(other["_id"]) & (F.xxhash64(docs["text"]) == other["_hash"])

    alone = keys.where("not _stays or _again")
    again = keys.where("_stays and _again")
    mark = free_prefix(docs, "_hash")
    repeated = docs.join(again, same(again), "left_semi").withColumn(mark, F.xxhash64("text")).dropDuplicates(["doc_id", mark]).drop(mark)
    return docs.join(alone, same(alone), "left_anti").union(repeated)
