"""SimHash near-duplicates, found through pivot distance tables.

A pivot table holds the Hamming distances of a fingerprint to many reference
fingerprints. The references come in families: those of one family differ from
the base reference inside one block of bits only, so their distances, less the
one to the base, are distances inside that block. Two fingerprints that differ
in at most d bits have all distances of at least `blocks` - d families in
common, and no distance to any reference differs by more than d. The first
fact gives exact join keys, the second discards pairs before the bits are
compared. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, written
from tallyspark.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCKS = 6
#: References of a family besides the base one. They tell fingerprints of a block apart.
REFERENCES = 24
#: Fingerprints of one key that one task compares; larger keys are split into pairs of chunks.
CHUNK = 4096
_BITS = 64


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8; 0 without words."""
    w = text.lower().split()  # bytes: A-Z, and the six ASCII spaces
    if not w:
        return 0
    if len(w) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    line = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array(
        [digest(line[a:b], SEED) for a, b in zip(start, end[SHINGLE_WORDS - 1 :].tolist())],
        np.uint64,
    )
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(h), 1 << 14):  # bounded, however long the text
        part = h[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(`doc_id`, `fp`), `fp` as a signed long with the fingerprint's bits; null text: 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(
                [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(1)], np.uint64
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS) -> list[int]:
    edges = [round(k * _BITS / blocks) for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def references(blocks: int = BLOCKS, per_block: int = REFERENCES, seed: int = SEED) -> np.ndarray:
    """Reference fingerprints: the base, then `per_block` for each block that differ from it there only."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1
    out = [base]
    for mask in block_masks(blocks):
        for _ in range(per_block):
            out.append(base ^ (int.from_bytes(rng.bytes(8), "little") & mask))
    return np.array(out, np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distances, a row per fingerprint and a column per reference."""
    return np.bitwise_count(fps[:, None] ^ refs[None, :])


def join_keys(fps: np.ndarray, refs: np.ndarray, blocks: int, max_bits: int) -> np.ndarray:
    """Per fingerprint a key for each choice of `blocks` - `max_bits` families.

    A key hashes the distances to the references of the families chosen, each
    less the distance to the base. Equal distances give equal keys; a collision
    only adds a pair that the distances then discard.
    """
    table = pivot_table(fps, refs).astype(np.int64)
    inside = (table[:, 1:] - table[:, :1]).reshape(len(fps), blocks, -1)
    rng = np.random.default_rng(1)
    weight = rng.integers(1, 1 << 62, inside.shape[1:], dtype=np.int64) | 1
    per_block = (inside * weight).sum(axis=2)  # wraps around, as hashes do
    choices = list(combinations(range(blocks), blocks - max_bits))
    salt = rng.integers(0, 1 << 62, len(choices), dtype=np.int64)
    return np.stack([per_block[:, list(c)].sum(axis=1) ^ s for c, s in zip(choices, salt)], axis=1)


#: Coordinates that are looked at together; pairs that they discard need no more.
_TOGETHER = 16


def within(table: np.ndarray, x: np.ndarray | int, y: np.ndarray, max_bits: int) -> np.ndarray:
    """Of the pairs (`x`, `y`) of rows of a pivot table, those whose largest coordinate difference is at most `max_bits`.

    `x` is one row or as many as `y`; the result numbers the pairs.
    """
    left = np.arange(len(y))
    for c in range(0, table.shape[1], _TOGETHER):
        some = table[:, c : c + _TOGETHER]
        other = some[x] if np.ndim(x) == 0 else some[x[left]]
        left = left[(np.abs(some[y[left]] - other) <= max_bits).all(axis=1)]
        if not len(left):
            break
    return left


def spanning_links(fps: np.ndarray, table: np.ndarray, max_bits: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect just what all links within `max_bits` connect: a breadth-first forest.

    A point that was reached is never compared as a target again, so a dense
    group takes few rounds. Then the numbers of pairs, of those that the pivot
    `table` leaves, and of links among these.
    """
    rest = np.arange(len(fps))
    links, counts = [], np.zeros(3, np.int64)
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            alive = rest[within(table, int(x), rest, max_bits)]
            hit = alive[np.bitwise_count(fps[alive] ^ fps[x]) <= max_bits]
            counts += (len(rest), len(alive), len(hit))
            if len(hit):
                links += [(int(x), int(y)) for y in hit]
                near = np.ones(len(rest), bool)
                near[np.searchsorted(rest, hit)] = False
                rest = rest[near]
                queue += hit.tolist()
    return links, counts


def dealt(rows: DataFrame, key: str, member: str, pieces: Column, calls: int) -> DataFrame:
    """`rows` with the column `call`, and `p` and `q`: which rows a call compares with which.

    A key of one piece is compared whole, and shares its call with other small
    keys: a call of its own would cost more than its work. The members of a
    larger key go to `pieces` at random, and every pair (`p`, `q`) of pieces,
    also of a piece with itself, is a call of its own.
    """
    own = F.pmod(F.xxhash64(member, key), F.col("pieces")).cast("int")
    spread = rows.withColumn("pieces", pieces.cast("int")).withColumn("own", own)
    # Piece p takes part in the pairs (p, q) and (q, p) for every q.
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    spread = spread.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")})
    call = F.when(F.col("pieces") == 1, F.pmod(F.xxhash64(key), F.lit(calls))).otherwise(F.xxhash64(key, "p", "q"))
    return spread.withColumn("call", call).drop("pieces", "own", "other")


def key_rows(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(`key`, `fp`, `p`, `q`, `call`): the distinct `fp` under their join keys, dealt to calls.

    A call holds a few thousand rows, or twice `chunk` of a key with more.
    """
    if not 0 < max_bits < blocks <= 16:
        raise ValueError("0 < max_bits < blocks <= 16")
    refs = references(blocks)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys = join_keys(part, refs, blocks, max_bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(part.view(np.int64), keys.shape[1]))], ["key", "fp"]
                )

    rows = written(distinct.select("fp").mapInArrow(keyed, "key long, fp long"), "simhash-keys")
    # Keys of one fingerprint only are most of them; they link nothing.
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return dealt(rows.join(sizes, "key"), "key", "fp", F.ceil(F.col("n") / chunk), _calls(distinct)).drop("n")


def compared(rows: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (`a`, `b`) from `key_rows`; and per call a row without ends, with its `pairs`, those `left` by the pivot distances, and `links`."""
    refs = references(blocks)

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[["key", "p", "q"]].to_numpy()
        fps = frame["fp"].to_numpy().view(np.uint64)
        order = np.lexsort(key.T[::-1])
        key, fps = key[order], fps[order]
        table = pivot_table(fps, refs).astype(np.int8)
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
        size = np.diff(np.append(first, len(fps)))
        # Keys of two are most of them: all their pairs at once.
        x = first[size == 2]
        y = x + 1
        left = within(table, x, y, max_bits)
        hit = left[np.bitwise_count(fps[x[left]] ^ fps[y[left]]) <= max_bits]
        counts = np.array([len(x), len(left), len(hit)], np.int64)
        a, b = [fps[x[hit]]], [fps[y[hit]]]
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            links, more = spanning_links(fps[at : at + n], table[at : at + n], max_bits)
            counts += more
            if links:
                ends = np.array(links) + at
                a.append(fps[ends[:, 0]])
                b.append(fps[ends[:, 1]])
        a, b = (pd.array(np.concatenate(c).view(np.int64), "Int64") for c in (a, b))
        out = pd.DataFrame({"a": a, "b": b, "pairs": 0, "left": 0, "links": 0})
        total = pd.DataFrame({"a": pd.array([pd.NA], "Int64"), "b": pd.array([pd.NA], "Int64"), **{c: [n] for c, n in zip(("pairs", "left", "links"), counts.tolist())}})
        return pd.concat([out, total], ignore_index=True)

    return rows.groupBy("call").applyInPandas(link, "a long, b long, pairs long, left long, links long")


def fingerprint_links(
    distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK
) -> DataFrame:
    """Links (`a`, `b`) that connect the distinct `fp` exactly as all pairs within `max_bits` do.

    An empty table gives no links.
    """
    found = compared(key_rows(distinct, max_bits, blocks, chunk), max_bits, blocks)
    return found.where("a is not null").select("a", "b").distinct()


def pair_report(distinct: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """One row: the `pairs` of distinct `fp` under a key, how many the pivot distances `discarded`, how many were `verified`, and the `links` found."""
    found = compared(key_rows(distinct, max_bits, blocks, chunk), max_bits, blocks).where("a is null")
    pairs, left, links = (F.coalesce(F.sum(c), F.lit(0)) for c in ("pairs", "left", "links"))
    return found.select(pairs.alias("pairs"), (pairs - left).alias("discarded"), left.alias("verified"), links.alias("links"))


def _calls(distinct: DataFrame) -> int:
    """Calls for the small keys: about 4,000 fingerprints each."""
    return max(64, distinct.count() // 4000)


def _by_fingerprint(fps: DataFrame, max_bits: int, blocks: int) -> DataFrame:
    """(`_fp`, `_first`): for each fingerprint of `fps` the least `doc_id` in its component."""
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(fingerprint_links(nodes, max_bits, blocks))
    linked = cut(nodes.join(linked, nodes["fp"] == linked["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    ))
    # Cut, so that both sides of the join are dealt out anew and Spark splits a large component.
    ids = cut(linked.groupBy("component").agg(F.min("first").alias("_first")))
    return cut(linked.join(ids, "component").select(F.col("fp").alias("_fp"), "_first"))


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(`doc_id`, `fp`, `component_id`) for every row of `docs` (`doc_id`, `text`).

    Documents whose fingerprints differ in at most `max_bits` bits are linked;
    `component_id` is the smallest `doc_id` that links reach. Equal
    fingerprints are one node, however many documents have them. Null, empty
    and blank texts have the fingerprint 0 and are linked like any other. Rows
    that repeat give a row each. A null `doc_id` never is a component's id,
    unless it is alone there. Other columns are ignored.
    """
    fps = written(fingerprints(docs), "simhash-fingerprints")
    by_fp = _by_fingerprint(fps, max_bits, blocks)
    return fps.join(by_fp, fps["fp"] == by_fp["_fp"]).select("doc_id", "fp", F.col("_first").alias("component_id"))
