"""Concatenate and cut: documents laid end to end and cut into fixed windows.

Global offsets come from two passes. The first tokenizes, and notes per
document the running sum of tokens in its partition; the totals of the
partitions are summed to prefix sums. The second adds the two and cuts at
window borders, so a document gives one piece for each window it reaches into.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm.common import slices, written

WINDOW = 4096
END_ID = 2
#: Pre-tokens whose ids a worker remembers.
CACHE_PRE_TOKENS = 300_000
#: Characters of plain texts that are split together.
LEARN_CHARS = 500_000
#: A text without any of these is plain: Latin letters, ASCII marks and spaces, so that it is
#: composed already and every library agrees on its letters, digits and spaces.
NOT_PLAIN = re.compile("[\x00-\x08\x0e-\x1f\x7f-\xbf\xd7\xf7\u0130\u0180-\U0010ffff]")
#: The pattern of the word-level tokenizer for lower-cased plain texts; contractions come first.
PLAIN = "[a-z\xdf-\u017f]+|[0-9]|[^a-z0-9\xdf-\u017f\t-\r ]+"
WITH_APOSTROPHE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|" + PLAIN)
#: The same classes for the bytes of such texts: space 0, letter 1 (all bytes beyond ASCII), digit 2, mark 3.
BYTE_CLASS = np.array(
    [1 if c >= 128 or 97 <= c <= 122 else 2 if 48 <= c <= 57 else 0 if c == 32 or 9 <= c <= 13 else 3 for c in range(256)],
    np.uint8,
)


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> Tokenizer:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Encoder:
    """Ids of texts by a word-level tokenizer, each distinct pre-token of plain texts encoded once.

    Texts that are not plain, or hold a special string, the library encodes whole.
    """

    def __init__(self, path: str, cache: int = CACHE_PRE_TOKENS):
        self.tokenizer = _tokenizer(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = _id_type(path)
        self.width = int(self.kind[-1])
        self.pieces: dict[str, bytes] = {}
        self.cache = cache
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Ids of distinct pre-tokens, many of them in a text; those of each end with an id that ends a word."""
        chunks = [new[i : i + 256] for i in range(0, len(new), 256)]
        for chunk, ids in zip(chunks, self._encode([" ".join(c) for c in chunks])):
            ids = np.array(ids, self.kind)
            ends = (np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize
            if len(ends) == len(chunk):
                packed, at = ids.tobytes(), 0
                for p, end in zip(chunk, ends.tolist()):
                    self.pieces[p] = packed[at:end]
                    at = end
            else:
                for p, alone in zip(chunk, self._encode(chunk)):
                    self.pieces[p] = np.array(alone, self.kind).tobytes()

    def _ids(self, pre_tokens: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; the library sees those that the worker does not remember."""
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        ids = self.pieces
        self._learn([p for p in pre_tokens if p not in ids])
        return [ids[p] for p in pre_tokens]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Plain texts without apostrophes: split by the classes of their bytes, all together."""
        raw = [t.lower().encode() for t in texts]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        kind = BYTE_CLASS[data]
        before = np.append(np.uint8(0), kind[:-1])
        first = np.flatnonzero((kind != 0) & ((kind == 2) | (kind != before)))
        seen = kind != 0
        at = np.append(np.cumsum(seen)[first] - 1, seen.sum()).astype(np.int32)
        found = pa.Array.from_buffers(
            pa.string(), len(first), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data[seen].tobytes())]
        ).dictionary_encode()
        ids = self._ids(found.dictionary.to_pylist())
        size = np.array([len(x) for x in ids], np.int64) // self.width
        begin = np.cumsum(size) - size
        which = found.indices.to_numpy()
        each = size[which]
        total = np.cumsum(each)
        flat = np.frombuffer(b"".join(ids), self.kind)
        out = flat[np.repeat(begin[which] - total + each, each) + np.arange(each.sum())]
        ends = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raw]))
        cuts = np.append(0, total)[ends].tolist()
        return [out[x:y].tobytes() for x, y in zip([0, *cuts], cuts)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned integers of `kind`."""
        out: list[bytes | None] = [None] * len(texts)
        plain, chars = [], 0
        for i, text in enumerate(texts):
            if NOT_PLAIN.search(text) or any(s in text for s in self.special):
                out[i] = np.array(self._encode([text])[0], self.kind).tobytes()
            elif "'" in text:
                parts = WITH_APOSTROPHE.findall(text.lower())
                ids = dict(zip(known := list(set(parts)), self._ids(known)))
                out[i] = b"".join([ids[p] for p in parts])
            else:
                plain.append(i)
                chars += len(text)
            if plain and (chars > LEARN_CHARS or i + 1 == len(texts)):
                for k, ids in zip(plain, self._plain([texts[k] for k in plain])):
                    out[k] = ids
                plain, chars = [], 0
        return out


def _id_type(path: str) -> str:
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


_TOKENS = pa.schema(
    [("part", pa.int32()), ("before", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary())]
)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(`part`, `before`, `n`, `doc_id`, `ids`): packed ids, `end_id` last.

    `before` counts the tokens of the partition's documents in front.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = Encoder(path), TaskContext.get().partitionId(), 0
        last = np.array([end_id], encoder.kind).tobytes()
        width = len(last)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x + last for x in encoder.encode_many(texts)]
            n = np.array([len(x) // width for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(at), pa.array(n), batch.column(0), pa.array(ids, pa.binary())],
                schema=_TOKENS,
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "part int, before long, n long, doc_id long, ids binary")


def partition_offsets(tokens: DataFrame) -> DataFrame:
    """(`part`, `base`): tokens in all partitions before; one row per partition goes through the window."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of `docs` (`doc_id`, `text`) in windows of `window` tokens, one row per piece.

    `doc_id`, `start` and `length` of the piece in its document, `ids_crc32`,
    `doc_tokens`, `sequence_id`, `offset` in the window, and `ids`, packed as
    little-endian unsigned 32-bit integers. Every window but the last is full.
    Null and empty texts are their end id alone. Rows that repeat are packed
    each; a null id stays null. An empty table gives an empty result. Other
    columns are ignored.
    """
    kind = _id_type(path)
    width = int(kind[-1])
    tokens = written(tokenized(docs, path, end_id), "packing-tokens")
    # Written, so that its size is known: Spark broadcasts it only if it is small.
    placed = tokens.join(written(partition_offsets(tokens), "packing-offsets"), "part")
    schema = pa.schema(
        [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
        + [("ids", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, ids, begin in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, at = len(ids) // width, 0
                while at < n:
                    sequence, offset = divmod(begin + at, window)
                    length = min(window - offset, n - at)
                    piece = np.frombuffer(ids, kind, length, at * width).astype("<u4").tobytes()
                    rows.append((doc_id, at, length, zlib.crc32(piece), n, sequence, offset, piece))
                    at += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return placed.select("doc_id", "ids", (F.col("base") + F.col("before")).alias("begin")).mapInArrow(cut, _PIECES)
