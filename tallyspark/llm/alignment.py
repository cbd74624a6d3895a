"""Alignment of two tokenizers by lockstep merging.

Both encode a text to tokens that cover the same bytes. Two pointers walk over
the ends of the tokens; a link joins the two tokens they stand at, and where
both end at one byte the text is cut. One NumPy state vector holds the
pointers of all texts of a batch: each step emits the links and cuts of all of
them at once, and texts that are finished leave the vector. Long texts are
first parted at common ends, so that a step always moves many pointers.

How many documents hold a pair of ids linked is counted per block of documents
first; what is shuffled is a row per block and distinct pair, never a row per
document and pair.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm.common import slices, written
from tallyspark.llm.token_counts import PRE_TOKEN

#: UTF-8 bytes of texts that are aligned together; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000
#: UTF-8 bytes of documents in a block, whose pairs are counted together before the shuffle.
BLOCK_BYTES = 8_000_000
#: A text is parted at the first common end after so many tokens.
STRAND_TOKENS = 1024
#: Texts of these characters split alike in every library: ASCII and Latin letters.
_NOT_PLAIN = re.compile("[^\t\n\r -~¡-ſ]")


@lru_cache(maxsize=1)
def _byte_of() -> dict[str, int]:
    """Bytes by their printable stand-ins in byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Ids by a byte-level BPE file. Special strings are plain text.

    Plain texts go to a faster library with the file's own vocabulary, whose
    ids are in order of the merges; others to the file's own library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        own.encode_special_tokens = True
        self._own = own
        special = set(own.get_added_tokens_decoder())
        to_byte = _byte_of()
        self.bytes = [b""] * own.get_vocab_size()
        for token, i in own.get_vocab().items():
            self.bytes[i] = token.encode() if i in special else bytes(to_byte[c] for c in token)
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        ids = [ranks[bytes(to_byte[c] for c in m)] for m in merged]
        if ids != sorted(ids):
            raise ValueError("ids are not in the order of the merges")
        self._fast = tiktoken.Encoding("bytes", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [not _NOT_PLAIN.search(t) for t in texts]
        rest = iter(self._own.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self._fast.encode_ordinary(t) if p else next(rest).ids for t, p in zip(texts, plain)]


class Pieces:
    """Ids by a sentencepiece model, which puts a space in front of a text."""

    def __init__(self, path: str):
        self._own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self._own.get_piece_size()):
            piece = self._own.id_to_piece(i)
            if self._own.is_byte(i):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._own.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def _byte_level(path: str) -> ByteLevel:
    return ByteLevel(path)


@lru_cache(maxsize=4)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def _common_ends(ends_a: np.ndarray, ends_b: np.ndarray, every: int) -> list[tuple[int, int]]:
    """Where a text is parted: numbers of tokens of both sides up to common ends, `every` tokens or more apart, the last included."""
    cuts, at = [], 0
    while at + every < len(ends_a):
        at += every
        while at < len(ends_a):
            some = ends_a[at - 1 : at + 63]
            place = np.searchsorted(ends_b, some)
            hit = np.flatnonzero(ends_b[place] == some)  # the last ends are equal, so places are inside
            if len(hit):
                at += int(hit[0])
                cuts.append((at, int(place[hit[0]]) + 1))
                break
            at += 64
    if not cuts or cuts[-1][0] < len(ends_a):
        cuts.append((len(ends_a), len(ends_b)))
    return cuts


@dataclass
class Merged:
    """Links and cuts of a batch: numbers of the tokens of both sides, counted over the whole batch."""

    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lockstep(ends_a: list[np.ndarray], ends_b: list[np.ndarray], strand_tokens: int = STRAND_TOKENS) -> Merged:
    """Merges the token ends of many texts at once; both sides of a text end at the same byte."""
    sizes_a, sizes_b = [len(e) for e in ends_a], [len(e) for e in ends_b]
    first_a, first_b = np.cumsum([0, *sizes_a]), np.cumsum([0, *sizes_b])
    start_a, stop_a, start_b = [], [], []
    for k, (a, b) in enumerate(zip(ends_a, ends_b)):
        if not len(a):
            continue
        x = y = 0
        for to_a, to_b in _common_ends(a, b, strand_tokens) if len(a) > strand_tokens else [(len(a), len(b))]:
            start_a.append(first_a[k] + x)
            stop_a.append(first_a[k] + to_a)
            start_b.append(first_b[k] + y)
            x, y = to_a, to_b
    flat_a = np.concatenate([*ends_a, np.empty(0, np.int64)])
    flat_b = np.concatenate([*ends_b, np.empty(0, np.int64)])
    # The state vector: a pointer to each side, and where the strand ends.
    at_a, at_b, stop = (np.array(x, np.int64) for x in (start_a, start_b, stop_a))
    links, cuts = [], []
    while len(at_a):
        here_a, here_b = flat_a[at_a], flat_b[at_b]
        links.append((at_a, at_b))
        both = here_a == here_b
        if both.any():
            cuts.append((at_a[both], at_b[both]))
        at_a = at_a + (here_a <= here_b)
        at_b = at_b + (here_b <= here_a)
        alive = at_a < stop
        if not alive.all():
            at_a, at_b, stop = at_a[alive], at_b[alive], stop[alive]
    none = (np.empty(0, np.int64),) * 2
    link_a, link_b = (np.concatenate(x) for x in zip(none, *links))
    cut_a, cut_b = (np.concatenate(x) for x in zip(none, *cuts))
    return Merged(link_a, link_b, cut_a, cut_b)


@dataclass
class Batch:
    """A batch of aligned texts; `links` are (text, pair of ids, how often), sorted by text and pair."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    text: np.ndarray
    pair: np.ndarray
    times: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str, strand_tokens: int = STRAND_TOKENS):
        self.a, self.b = _byte_level(path_a), _pieces(path_b)
        self.strand_tokens = strand_tokens
        self.size_a = np.array([len(x) for x in self.a.bytes], np.int64)
        self.size_b = np.array([len(x) for x in self.b.bytes], np.int64)
        self.n_pieces = len(self.b.bytes)
        # An id as text with what follows it: within its side of a group, or at that side's end.
        a, b = range(len(self.a.bytes)), range(self.n_pieces)
        self.written = [b"%d," % i for i in a] + [b"%d|" % i for i in a] + [b"%d," % i for i in b] + [b"%d;" % i for i in b]

    def _ids(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        none = np.empty(0, np.int64)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        for k, a, b in zip(some, self.a.encode([" " + texts[k] for k in some]), self.b.encode([texts[k] for k in some])):
            whole = (" " + texts[k]).encode()
            if b"".join([self.a.bytes[i] for i in a]) == whole == b"".join([self.b.bytes[i] for i in b]):
                ids_a[k], ids_b[k] = np.array(a, np.int64), np.array(b, np.int64)
        return ids_a, ids_b

    def align(self, texts: list[str | None]) -> Batch:
        ids_a, ids_b = self._ids(texts)
        merged = lockstep(
            [np.cumsum(self.size_a[x]) for x in ids_a], [np.cumsum(self.size_b[x]) for x in ids_b], self.strand_tokens
        )
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
        flat_a, flat_b = (np.concatenate([*ids, np.empty(0, np.int64)]) for ids in (ids_a, ids_b))
        text_of = np.repeat(np.arange(len(texts)), n_a)
        link_text = text_of[merged.link_a]
        n_groups = np.bincount(text_of[merged.cut_a], minlength=len(texts))
        n_links = np.bincount(link_text, minlength=len(texts))

        pair = flat_a[merged.link_a] * self.n_pieces + flat_b[merged.link_b]
        key, times = np.unique(link_text.astype(np.uint64) << np.uint64(40) | pair.astype(np.uint64), return_counts=True)
        return Batch(
            n_a, n_b, n_groups, n_links, self._groups(flat_a, flat_b, merged, n_a, n_b),
            (key >> np.uint64(40)).astype(np.int64), (key & np.uint64((1 << 40) - 1)).astype(np.int64), times,
        )

    def _groups(self, flat_a: np.ndarray, flat_b: np.ndarray, merged: Merged, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """Per text `a1,a2|b1;a3|b2,b3`: each id goes behind all tokens of both sides that are written before it."""
        last_a, last_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
        last_a[merged.cut_a] = True
        last_b[merged.cut_b] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        ends_b = np.append(0, np.flatnonzero(last_b) + 1)  # tokens of b in the groups before each
        ends_a = np.append(0, np.flatnonzero(last_a) + 1)
        out = np.empty(len(flat_a) + len(flat_b), np.int64)
        size = len(self.a.bytes)
        out[np.arange(len(flat_a)) + ends_b[group_a]] = flat_a + size * last_a
        out[np.arange(len(flat_b)) + ends_a[group_b + 1]] = flat_b + 2 * size + self.n_pieces * last_b
        table, codes, at, groups = self.written, out.tolist(), 0, []
        for n in (n_a + n_b).tolist():
            groups.append(b"".join([table[c] for c in codes[at : at + n]])[:-1])
            at += n
        return groups


def _batches(rows: Iterator[tuple[int | None, str | None]], limit: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for doc_id, text in rows:
        n = len(text or "")
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((doc_id, text))
        size += n
    if held:
        yield held


_ALIGNED = pa.schema(
    [("block", pa.int64()), ("pair", pa.int64()), ("docs", pa.int64()), ("head", pa.binary()), ("hashes", pa.list_(pa.string()))]
    + [(c, pa.binary()) for c in ("text", "place", "times")]
)


def aligned(
    docs: DataFrame, path_a: str, path_b: str, batch_bytes: int = BATCH_BYTES, block_bytes: int = BLOCK_BYTES,
    strand_tokens: int = STRAND_TOKENS,
) -> DataFrame:
    """Rows per block of documents.

    A row with a `pair` (A's id times the number of B's pieces, plus B's id)
    has the `docs` of the block that hold it linked. One row without has the
    documents: `head`, packed 64-bit integers (id, whether it is null, `n_a`,
    `n_b`, `n_groups`, `n_links`), the hashes of their groups, and packed
    32-bit integers: of each distinct pair of a document the `text` it is
    in, its `place` among the block's pairs, ascending, and how many `times`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, part, number = Aligner(path_a, path_b, strand_tokens), TaskContext.get().partitionId(), 0
        rows = (r for b in slices(batches) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        held: list[tuple[list, Batch]] = []
        size = 0

        def block() -> Iterator[pa.RecordBatch]:
            name = (part << 32) + number
            head, hashes, text, first = [], [], [], 0
            for some, b in held:
                numbers = np.stack([b.n_a, b.n_b, b.n_groups, b.n_links], axis=1).tolist()
                head += [(doc_id or 0, doc_id is None, *n) for (doc_id, _), n in zip(some, numbers)]
                hashes += [hashlib.sha256(g).hexdigest() if g else "" for g in b.groups]
                text.append(b.text + first)
                first += len(some)
            pairs, place, docs = np.unique(
                np.concatenate([b.pair for _, b in held]), return_inverse=True, return_counts=True
            )
            times = np.concatenate([b.times for _, b in held])
            packed = [x.astype("<u4").tobytes() for x in (np.concatenate(text), place, times)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                    pa.array([np.array(head, "<i8").tobytes()], pa.binary()), pa.array([hashes], pa.list_(pa.string())),
                    *(pa.array([x], pa.binary()) for x in packed),
                ],
                schema=_ALIGNED,
            )
            for i in range(0, len(pairs), 50_000):
                some = pairs[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), name)), pa.array(some), pa.array(docs[i : i + 50_000]),
                        *(pa.nulls(len(some), f.type) for f in list(_ALIGNED)[3:]),
                    ],
                    schema=_ALIGNED,
                )

        for some in _batches(rows, batch_bytes):
            n = sum(len(t or "") for _, t in some)
            if held and size + n > block_bytes:
                yield from block()
                held, size, number = [], 0, number + 1
            held.append(([(doc_id, None) for doc_id, _ in some], aligner.align([t for _, t in some])))
            size += n
        if held:
            yield from block()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(
        run, "block long, pair long, docs long, head binary, hashes array<string>, text binary, place binary, times binary"
    )


def pair_counts(rows: DataFrame, n_pieces: int) -> DataFrame:
    """(`pair`, `count`, `best`): documents that hold the pair linked, and whether no pair of the same A id has more.

    A window holds the pairs of one A id: no more than B has pieces.
    """
    counts = rows.where("pair is not null").groupBy("pair").agg(F.sum("docs").alias("count"))
    of_a = Window.partitionBy(F.expr(f"pair div {n_pieces}"))
    return counts.select("pair", "count", (F.col("count") == F.max("count").over(of_a)).alias("best"))


def alignment(
    docs: DataFrame, path_a: str, path_b: str, batch_bytes: int = BATCH_BYTES, block_bytes: int = BLOCK_BYTES,
    strand_tokens: int = STRAND_TOKENS,
) -> DataFrame:
    """A row per row of `docs` (`doc_id`, `text`): how the tokens of A (byte-level BPE) and B (sentencepiece) align.

    `n_a`, `n_b` tokens, `n_groups` between cuts, `n_links`; `n_best` links
    whose pair is held by as many documents as any of their A id, `count_sum`
    over the documents that hold each link's pair; `groups_sha256`. Null and
    empty texts, and texts whose bytes the tokens do not give back, have no
    tokens: zeros and "". Repeated rows are documents each, null ids too. An
    empty table gives an empty result. Other columns are ignored.
    """
    n_pieces = len(_pieces(path_b).bytes)
    rows = written(aligned(docs, path_a, path_b, batch_bytes, block_bytes, strand_tokens), "alignment-blocks")
    # Written, so that its size is known: Spark broadcasts it only if it is small.
    counts = written(pair_counts(rows, n_pieces), "alignment-pairs")
    known = rows.where("pair is not null").select(F.col("block").alias("of"), "pair").join(counts, "pair")
    texts = rows.where("pair is null").select("block", "head", "hashes", "text", "place", "times")

    def summed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        head = np.frombuffer(row["head"], "<i8").reshape(-1, 6)
        order = np.argsort(right["pair"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        text, place, times = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("text", "place", "times"))
        n_best, count_sum = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        if len(text):
            np.add.at(n_best, text, best[place] * times)
            np.add.at(count_sum, text, count[place] * times)
        ids = pd.array(head[:, 0], "Int64")
        ids[head[:, 1] == 1] = pd.NA
        return pd.DataFrame(
            {
                "doc_id": ids, "n_a": head[:, 2], "n_b": head[:, 3], "n_groups": head[:, 4], "n_links": head[:, 5],
                "n_best": n_best, "count_sum": count_sum, "groups_sha256": list(row["hashes"]),
            }
        )

    return (
        texts.groupBy("block")
        .cogroup(known.groupBy("of"))
        .applyInPandas(
            summed,
            "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
        )
    )
