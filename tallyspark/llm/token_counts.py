"""Token counts without ids: pieces counted once per distinct pre-token, joined to frequencies.

The frequencies leave a block of documents as one row per pre-token, with the
documents that hold it packed as (position, frequency). All rows of a
pre-token, from as many partitions of documents as `TOGETHER`, then meet in
one partition, sorted, where the tokenizer counts its pieces once and the
count is joined to the frequencies. A pre-token has at most one row per block,
so that the rows that meet are bounded, however large the table and frequent
the pre-token. What goes on to the sums is, per block and partition, one
packed row.
"""

from __future__ import annotations

import os
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: Fixed value: the pattern by which the byte-level tokenizers split a text.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of documents in a block; a longer document is a block of its own.
BLOCK_CHARS = 16_000_000
#: Packed (document, frequency) pairs that a task sums before it passes the sums on.
FLUSH_PAIRS = 2_000_000
#: Partitions of documents whose rows of a pre-token meet, a power of two. Larger tables count its pieces once for each so many.
TOGETHER = 64
_FREQUENCY_BITS = 8
_MOST = (1 << _FREQUENCY_BITS) - 1


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def _special(path: str):
    """The special strings of the tokenizer as one pattern with a group, or None."""
    special = sorted((x.content for x in _tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None


_split = regex.compile(PRE_TOKEN).findall


@lru_cache(maxsize=4)
def vocabulary_counts(path: str) -> dict[str, int]:
    """Pieces of each vocabulary entry that is a pre-token: bounded by the size of the vocabulary."""
    t, special = _tokenizer(path), _special(path)
    words = [t.decode([i], skip_special_tokens=False) for i in range(t.get_vocab_size())]
    words = [w for w in words if "�" not in w and _split(w) == [w] and not (special and special.search(w))]
    return dict(zip(words, piece_counts(path, words)))


def piece_counts(path: str, pre_tokens: list[str]) -> list[int]:
    return [len(e) for e in _tokenizer(path).encode_batch_fast(pre_tokens, add_special_tokens=False)]


def pre_token_frequencies(path: str, text: str) -> tuple[Counter, int]:
    """Frequencies of the pre-tokens of a text, and the number of special strings in it."""
    special = _special(path)
    if special is None or not special.search(text):
        return Counter(_split(text)), 0
    parts = special.split(text)  # texts and special strings in turn
    count: Counter = Counter()
    for part in parts[::2]:
        count.update(_split(part))
    return count, len(parts) // 2


def _blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[list[tuple]]:
    block, chars = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or ""
            if block and (chars + len(text) > limit or len(block) >> (32 - _FREQUENCY_BITS)):
                yield block
                block, chars = [], 0
            block.append((doc_id, text))
            chars += len(text)
    if block:
        yield block


_FREQUENCIES = pa.schema(
    [("block", pa.int64()), ("pre_token", pa.string()), ("pairs", pa.binary()), ("head", pa.binary())]
)


def frequencies(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows per block of documents.

    A row with a `pre_token` has `pairs`, packed 32-bit integers of which each
    is a document's position in the block and a frequency. One row without a
    pre-token has the `head` of the block: packed 64-bit integers, per
    document its id, whether the id is null, its bytes, and what its special
    strings and its pre-tokens in the vocabulary sum to.
    """

    def run(batches):
        from pyspark import TaskContext

        vocabulary = vocabulary_counts(path)
        part = TaskContext.get().partitionId()
        for n, block in enumerate(_blocks(batches, block_chars)):
            name, head, pairs = (part << 32) + n, [], defaultdict(list)
            for k, (doc_id, text) in enumerate(block):
                count, total = pre_token_frequencies(path, text)
                at = k << _FREQUENCY_BITS
                for token, f in count.items():
                    pieces = vocabulary.get(token)
                    if pieces is not None:
                        total += pieces * f
                        continue
                    while f > _MOST:
                        pairs[token].append(at | _MOST)
                        f -= _MOST
                    pairs[token].append(at | f)
                head.append((doc_id or 0, doc_id is None, len(text.encode()), total))
            packed = np.array(head, "<i8").tobytes()
            yield pa.RecordBatch.from_pylist([{"block": name, "head": packed}], schema=_FREQUENCIES)
            tokens = list(pairs)
            for i in range(0, len(tokens), 20000):
                some = tokens[i : i + 20000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(some), pa.int64()),
                        pa.array(some),
                        pa.array([np.array(pairs[t], "<u4").tobytes() for t in some], pa.binary()),
                        pa.nulls(len(some), pa.binary()),
                    ],
                    schema=_FREQUENCIES,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "block long, pre_token string, pairs binary, head binary"
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """`rows` by pre-token and `TOGETHER` partitions of documents; a block's number begins with its partition's."""
    group = F.shiftright("block", 32 + TOGETHER.bit_length() - 1)
    return rows.repartition(F.coalesce("pre_token", F.col("block").cast("string")), group).sortWithinPartitions("pre_token")


def counted(rows: DataFrame, path: str, flush_pairs: int = FLUSH_PAIRS) -> DataFrame:
    """(`block`, `head`, `at`, `sums`): the heads, and tokens per document summed over pre-tokens."""
    schema = pa.schema([("block", pa.int64()), ("head", pa.binary()), ("at", pa.binary()), ("sums", pa.binary())])

    def sums(held: dict[int, list]) -> pa.RecordBatch:
        out = {c: [] for c in schema.names}
        for block, parts in held.items():
            at = np.concatenate([a for a, _ in parts])
            value = np.concatenate([v for _, v in parts])
            each = np.bincount(at, value)  # float64: exact below 2 ** 53
            has = np.flatnonzero(each)
            out["block"].append(block)
            out["head"].append(None)
            out["at"].append(has.astype("<u4").tobytes())
            out["sums"].append(each[has].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(batches):
        held, n, last, last_pieces = defaultdict(list), 0, None, 0
        for batch in batches:
            frame = batch.to_pandas()
            is_head = frame["pre_token"].isna()
            if is_head.any():
                some = frame[is_head]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some["block"], pa.int64()), pa.array(some["head"], pa.binary()), *(pa.nulls(len(some), pa.binary()) for _ in range(2))],
                    schema=schema,
                )
                frame = frame[~is_head]
            if not len(frame):
                continue
            tokens = frame["pre_token"].to_numpy()
            first = np.append(True, tokens[1:] != tokens[:-1])  # sorted: each distinct pre-token once
            new = tokens[first].tolist()
            known = new[0] == last
            pieces = ([last_pieces] if known else []) + piece_counts(path, new[1:] if known else new)
            last, last_pieces = new[-1], pieces[-1]
            pieces = np.array(pieces, np.int64)[np.cumsum(first) - 1]
            size = frame["pairs"].str.len().to_numpy() // 4
            pairs = np.frombuffer(b"".join(frame["pairs"]), "<u4")
            value = np.repeat(pieces, size) * (pairs & _MOST).astype(np.int64)
            at = (pairs >> _FREQUENCY_BITS).astype(np.int64)
            blocks = np.repeat(frame["block"].to_numpy(), size)
            order = np.argsort(blocks, kind="stable")
            blocks, at, value = blocks[order], at[order], value[order]
            edges = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks))
            for a, b in zip(edges, edges[1:]):
                held[int(blocks[a])].append((at[a:b], value[a:b]))
            n += len(pairs)
            if n > flush_pairs:
                yield sums(held)
                held, n = defaultdict(list), 0
        if held:
            yield sums(held)

    return _dealt(rows).mapInArrow(run, "block long, head binary, at binary, sums binary")


def token_counts(
    docs: DataFrame, path: str, limit: int = 1024, block_chars: int = BLOCK_CHARS, flush_pairs: int = FLUSH_PAIRS
) -> DataFrame:
    """(`doc_id`, `n_bytes`, `n_tokens`, `over_limit`) for every row of `docs` (`doc_id`, `text`).

    `path` is a byte-level BPE tokenizer file. Special strings inside a text
    count as one token each, as the library takes them by default. Null and
    empty texts: 0 bytes, 0 tokens. Rows that repeat give a row each, null ids
    too. Other columns are ignored.
    """

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        is_head = frame["head"].notna()
        head = np.frombuffer(frame.loc[is_head, "head"].iloc[0], "<i8").reshape(-1, 4)
        rest = frame[~is_head]
        n = head[:, 3].copy()
        if len(rest):
            at = np.frombuffer(b"".join(rest["at"]), "<u4")
            np.add.at(n, at, np.frombuffer(b"".join(rest["sums"]), "<u4").astype(np.int64))
        ids = pd.array(head[:, 0], "Int64")
        ids[head[:, 1] == 1] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_bytes": head[:, 2], "n_tokens": n})

    rows = counted(frequencies(docs, path, block_chars), path, flush_pairs)
    sums = rows.groupBy("block").applyInPandas(total, "doc_id long, n_bytes long, n_tokens long")
    return sums.select("*", (F.col("n_tokens") > limit).alias("over_limit"))
