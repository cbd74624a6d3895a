"""Token ids as wavelet matrices (Claude, Navarro and Ordonez 2015), in compressed shard files.

A shard holds whole documents. Its matrix has one bit-plane per bit of an id,
highest first; the ids whose bit is 0 come first in the order of the next
plane. A plane is cut into blocks, compressed each, with the number of ones in
front of each block beside it. So the id at a place, the number of times an id
occurs in a range, and its occurrences are found by rank and select over a few
blocks, without unpacking the shard.

The shard files are written by Spark's writer, one file per partition, in
ascending order of `doc_id`: their names, and the number of each partition in
the shards, keep that order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import scratch, slices, written
from tallyspark.llm.packing import END_ID, Encoder

#: A shard is closed when it holds so many ids; a longer document is a shard of its own.
SHARD_TOKENS = 1_000_000
#: Bytes of a plane that are compressed together.
BLOCK_BYTES = 1 << 15
_MAGIC = b"WAVEMTX1"
#: Magic, length of the shard in bytes, partition, ids of the partition in front, ids, documents, planes.
_HEAD = struct.Struct("<8sQIQQII")


def _pack(data: bytes) -> bytes:
    return struct.pack("<QQ", len(data), len(z := pa.compress(data, "zstd", asbytes=True))) + z


def _unpack(data: memoryview, at: int) -> tuple[bytes, int]:
    size, packed = struct.unpack_from("<QQ", data, at)
    end = at + 16 + packed
    return pa.decompress(data[at + 16 : end], size, "zstd", asbytes=True) if size else b"", end


def planes_of(ids: np.ndarray, planes: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per plane, highest bit first: the number of zeros, and the packed bits."""
    for k in reversed(range(planes)):
        bit = (ids & ids.dtype.type(1 << k)) != 0
        # Places instead of masks: several times as fast where the bits change often.
        low = ids[np.flatnonzero(~bit)]
        yield len(low), np.packbits(bit, bitorder="little")
        ids = np.concatenate([low, ids[np.flatnonzero(bit)]])


def write_shard(ids: np.ndarray, docs: list[tuple[int | None, int]], planes: int, part: int = 0, before: int = 0) -> bytes:
    """A shard of `ids`, the documents (`doc_id`, number of ids) one after the other."""
    names = np.array([d or 0 for d, _ in docs], "<i8")
    nameless = np.packbits(np.array([d is None for d, _ in docs], bool))
    ends = np.cumsum(np.array([n for _, n in docs], "<i8"))
    if int(ends[-1] if len(ends) else 0) != len(ids):
        raise ValueError("the documents do not cover the ids")
    out = [_pack(names.tobytes()), _pack(nameless.tobytes()), _pack(ends.astype("<i8").tobytes())]
    for zeros, bits in planes_of(ids, planes):
        blocks = [bits[i : i + BLOCK_BYTES] for i in range(0, len(bits), BLOCK_BYTES)]
        ones = np.cumsum([0, *(int(np.bitwise_count(b).sum()) for b in blocks)])
        packed = [pa.compress(b.tobytes(), "zstd", asbytes=True) for b in blocks]
        ends_at = np.cumsum([0, *map(len, packed)])
        out.append(struct.pack("<QI", zeros, len(blocks)) + ones.astype("<i8").tobytes() + ends_at.astype("<i8").tobytes())
        out += packed
    body = b"".join(out)
    return _HEAD.pack(_MAGIC, _HEAD.size + len(body), part, before, len(ids), len(docs), planes) + body


class _Plane:
    """Rank and select over one bit-plane; blocks are unpacked when they are asked for."""

    def __init__(self, data: memoryview, at: int, n: int):
        self.n = n
        self.zeros, blocks = struct.unpack_from("<QI", data, at)
        at += 12
        self.ones = np.frombuffer(data, "<i8", blocks + 1, at)
        at += 8 * (blocks + 1)
        self.ends = np.frombuffer(data, "<i8", blocks + 1, at)
        self.at = at + 8 * (blocks + 1)
        self.end = self.at + int(self.ends[-1])
        self.data = data
        self.size = (n + 7) // 8
        self.block = lru_cache(maxsize=64)(self._block)

    def _block(self, k: int) -> np.ndarray:
        size = min(BLOCK_BYTES, self.size - k * BLOCK_BYTES)
        packed = self.data[self.at + int(self.ends[k]) : self.at + int(self.ends[k + 1])]
        return np.frombuffer(pa.decompress(packed, size, "zstd", asbytes=True), np.uint8)

    def bits(self) -> np.ndarray:
        """All bits of the plane."""
        blocks = [self._block(k) for k in range(len(self.ends) - 1)]
        return np.unpackbits(np.concatenate(blocks or [np.empty(0, np.uint8)]), count=self.n, bitorder="little").view(bool)

    def get(self, i: int) -> int:
        k, at = divmod(i, 8 * BLOCK_BYTES)
        return int(self.block(k)[at >> 3]) >> (at & 7) & 1

    def rank(self, bit: int, i: int) -> int:
        """How many of the first `i` bits are `bit`."""
        k, at = divmod(i, 8 * BLOCK_BYTES)
        ones = int(self.ones[k])
        if at:
            block = self.block(k)
            ones += int(np.bitwise_count(block[: at >> 3]).sum())
            if at & 7:
                ones += (int(block[at >> 3]) & (1 << (at & 7)) - 1).bit_count()
        return ones if bit else i - ones

    def select(self, bit: int, which: np.ndarray) -> np.ndarray:
        """Places of the bits equal to `bit` whose numbers, from 0, are `which`, ascending."""
        starts = np.minimum(np.arange(len(self.ones)) * 8 * BLOCK_BYTES, self.n)
        before = self.ones if bit else starts - self.ones
        blocks = np.searchsorted(before, which, side="right") - 1
        out = np.empty(len(which), np.int64)
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for part in np.split(np.arange(len(which)), cuts) if len(which) else ():
            k = int(blocks[part[0]])
            count = min(8 * BLOCK_BYTES, self.n - int(starts[k]))
            same = np.unpackbits(self.block(k), count=count, bitorder="little") == bit
            out[part] = starts[k] + np.flatnonzero(same)[which[part] - before[k]]
        return out


class Shard:
    """Reads one shard."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        magic, size, self.part, self.before, self.n, n_docs, planes = _HEAD.unpack_from(data)
        if magic != _MAGIC or size > len(data):
            raise ValueError("not a whole shard")
        names, at = _unpack(data, _HEAD.size)
        nameless, at = _unpack(data, at)
        ends, at = _unpack(data, at)
        none = np.unpackbits(np.frombuffer(nameless, np.uint8), count=n_docs)
        self.doc_ids = [None if x else i for i, x in zip(np.frombuffer(names, "<i8").tolist(), none.tolist())]
        self.ends = np.frombuffer(ends, "<i8")
        self.planes = []
        for _ in range(planes):
            self.planes.append(_Plane(data, at, self.n))
            at = self.planes[-1].end
        if at != size:
            raise ValueError("the shard's planes do not end where the shard does")

    def __len__(self) -> int:
        return self.n

    def access(self, i: int) -> int:
        """The id at place `i`."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            bit = plane.get(i)
            value = value << 1 | bit
            i = plane.rank(bit, i) + (plane.zeros if bit else 0)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        """The range below the last plane in which `token` from [`start`, `end`) lies."""
        if token < 0 or token >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            bit = token >> (len(self.planes) - 1 - k) & 1
            offset = plane.zeros if bit else 0
            start, end = offset + plane.rank(bit, start), offset + plane.rank(bit, end)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often `token` occurs in [`start`, `end`)."""
        end = self.n if end is None else min(end, self.n)
        if start >= end:
            return 0
        low, high = self._range(token, start, end)
        return high - low

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> np.ndarray:
        """The places of `token` in [`start`, `end`), ascending."""
        end = self.n if end is None else min(end, self.n)
        low, high = self._range(token, start, end) if start < end else (0, 0)
        at = np.arange(low, high)
        for k, plane in enumerate(reversed(self.planes)):
            bit = token >> k & 1
            at = plane.select(bit, at - (plane.zeros if bit else 0))
        return at

    def ids(self) -> np.ndarray:
        """All ids: from the last plane up, the two halves are dealt back by the bits of the plane above."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        below = np.zeros(self.n, kind)
        for k, plane in enumerate(reversed(self.planes)):
            bit = plane.bits()
            here = np.empty(self.n, kind)
            here[np.flatnonzero(~bit)] = below[: plane.zeros]
            here[np.flatnonzero(bit)] = below[plane.zeros :] | kind(1 << k)
            below = here
        return below


def shards_of(data: bytes) -> Iterator[Shard]:
    """The shards of a file, one after the other."""
    view, at = memoryview(data), 0
    while at < len(view):
        size = _HEAD.unpack_from(view, at)[1]
        yield Shard(view[at : at + size])
        at += size + 1  # the writer puts a line end after each


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """The ids of `docs` (`doc_id`, `text`) as shard files below `path`, in ascending order of `doc_id`.

    Rows of one id follow each other in the order they are read in; null ids
    come first. Each document's ids end with `end_id`; null and empty texts
    are that id alone. An id that many rows share spreads over many files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, before = Encoder(tokenizer), TaskContext.get().partitionId(), 0
        planes = max(1, (max(encoder.tokenizer.get_vocab_size() - 1, end_id)).bit_length())
        last = np.array([end_id], encoder.kind).tobytes()
        held, listed, n = [], [], 0

        def shard() -> pa.RecordBatch:
            data = write_shard(np.frombuffer(b"".join(held), encoder.kind), listed, planes, part, before)
            # The text writer takes bytes as they are.
            cell = pa.StringArray.from_buffers(1, pa.py_buffer(struct.pack("<ii", 0, len(data))), pa.py_buffer(data))
            return pa.RecordBatch.from_arrays([cell], ["value"])

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(texts)):
                ids += last
                size = len(ids) // encoder.width
                if held and n + size > shard_tokens:
                    yield shard()
                    before += n
                    held, listed, n = [], [], 0
                held.append(ids)
                listed.append((doc_id, size))
                n += size
        if held:
            yield shard()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))
    ordered = source.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    ordered.select("doc_id", "text").mapInArrow(run, "value string").write.option("lineSep", "\n").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


_DOCUMENTS = "part int, before long, doc_id long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(`doc_id`, `start`, `n_tokens`, `ids_crc32`) of every document in the shards below `path`.

    `start` counts the ids of all documents in front. `ids_crc32` is over the
    ids as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for shard in shards_of(content.as_py()):
                    raw = memoryview(shard.ids().astype("<u4").tobytes())
                    starts = np.append(0, shard.ends[:-1])
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), shard.ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([shard.part] * len(crc), pa.int32()), pa.array(shard.before + starts),
                            pa.array(shard.doc_ids, pa.int64()), pa.array(shard.ends - starts), pa.array(crc, pa.int64()),
                        ],
                        ["part", "before", "doc_id", "n_tokens", "ids_crc32"],
                    )

    read = written(_files(spark, path).select("content").mapInArrow(run, _DOCUMENTS), "wavelet-documents")
    # One row per file goes through the window; written, so that Spark broadcasts it only if it is small.
    totals = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    front = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select("part", F.coalesce(F.sum("n").over(front), F.lit(0)).alias("base")), "wavelet-bases")
    return read.join(bases, "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_occurrences(spark: SparkSession, path: str, tokens: Iterable[int]) -> DataFrame:
    """(`token`, `doc_id`, `position`) of every occurrence of the ids `tokens` in the shards below `path`.

    Each shard looks the ids up in its planes; `position` counts the
    document's ids in front. Repeated ids of `tokens` count once.
    """
    wanted = sorted(set(tokens))
    schema = pa.schema([("token", pa.int64()), ("doc_id", pa.int64()), ("position", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for shard in shards_of(content.as_py()):
                    starts = np.append(0, shard.ends[:-1])
                    ids = pa.array(shard.doc_ids, pa.int64())
                    for token in wanted:
                        at = shard.occurrences(token)
                        doc = np.searchsorted(shard.ends, at, side="right")
                        if len(at):
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(len(at), token)), ids.take(pa.array(doc)), pa.array(at - starts[doc])], schema=schema
                            )

    return _files(spark, path).select("content").mapInArrow(run, "token long, doc_id long, position long")


def stored_documents(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """`docs` (`doc_id`, `text`) through shard files and read back, a row per row; see `read_documents`.

    Null and empty texts have the end id alone. Repeated rows are documents
    each, null ids too, which come first. An empty table gives an empty
    result. Other columns are ignored.
    """
    path = f"{scratch(docs.sparkSession, 'wavelet')}/shards"
    write_shards(docs, path, tokenizer, end_id, shard_tokens)
    return read_documents(docs.sparkSession, path)
