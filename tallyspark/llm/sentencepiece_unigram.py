"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A piece never holds a whitespace marker behind another character, so the best
segmentation of a text is made of the best ones of its words, each with its
markers in front. Spark gathers the distinct words of a block of documents;
their Viterbi tables are filled together, a position at a time in numpy.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import slices

MARKER = "▁"
#: Fixed value: how far an unknown character scores below the least piece.
UNKNOWN_PENALTY = 10.0
#: Code points of documents whose new words are encoded together; words that a worker remembers.
BLOCK_CHARS = 2_000_000
CACHE_WORDS = 500_000
#: Words that are encoded together.
BATCH_WORDS = 20_000
#: Cells of the tables that are filled together; a single longer word gets a table of its own.
TABLE_CELLS = 2_000_000
#: Bytes from which a word is encoded by itself, and places from which the trie is walked together then.
LONG_BYTES = 1024
STARTS = 1 << 16
_WORD = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


class DoubleArray:
    """A double-array trie over strings of bytes: child = base[node] + byte + 1, valid if check[child] = node."""

    def __init__(self, keys: list[bytes], values: list[int]):
        tree: dict = {}
        for key, value in zip(keys, values):
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        used = np.zeros(size, bool)
        used[0] = True
        lowest = 1
        queue = [(0, tree)]
        while queue:
            at, node = queue.pop()
            self.value[at] = node.get(-1, -1)
            codes = np.array(sorted(b + 1 for b in node if b >= 0), np.int64)
            if not len(codes):
                continue
            base = max(0, lowest - int(codes[0]))
            while True:  # the first base at which all children are free
                while base + 300 >= len(used):
                    grow = len(used)
                    self.base = np.append(self.base, np.zeros(grow, np.int32))
                    self.check = np.append(self.check, np.full(grow, -1, np.int32))
                    self.value = np.append(self.value, np.full(grow, -1, np.int32))
                    used = np.append(used, np.zeros(grow, bool))
                # Only bases that put the first child on a free place.
                free = np.flatnonzero(~used[base + codes[0] : base + codes[0] + 4096])
                fits = next((int(f) for f in free if base + f + 300 < len(used) and not used[base + f + codes].any()), None)
                if fits is not None:
                    base += fits
                    break
                base += 4096
            self.base[at] = base
            used[base + codes] = True
            self.check[base + codes] = at
            while used[lowest]:
                lowest += 1
            queue += [(base + b + 1, child) for b, child in node.items() if b >= 0]

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Children of `nodes` by the bytes `codes`; -1 where there is none."""
        child = self.base[nodes] + codes.astype(np.int32) + 1
        inside = child < len(self.check)
        child = np.where(inside, child, 0)
        return np.where(inside & (self.check[child] == nodes), child, -1)


class UnigramModel:
    """Pieces with log scores, encoded by Viterbi with byte fallback."""

    def __init__(self, pieces: list[str], scores: list[float], ordinary: list[bool], byte_ids: list[int], unknown: int):
        self.pieces = pieces
        self.scores = np.array(scores, np.float64)
        self.byte_ids = byte_ids  # empty without byte fallback
        self.unknown = unknown
        keys = [i for i, ok in enumerate(ordinary) if ok]
        self.trie = DoubleArray([pieces[i].encode() for i in keys], keys)
        self.unknown_score = min(scores[i] for i in keys) - UNKNOWN_PENALTY
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(byte_ids)}
        self.control = [not ok and i not in self.bytes_of for i, ok in enumerate(ordinary)]
        # What an id stands for: control pieces for nothing, the unknown piece for a mark.
        self.written = [p.encode() if ok else self.bytes_of.get(i, b"") for i, (p, ok) in enumerate(zip(pieces, ordinary))]
        self.written[unknown] = " \u2047 ".encode()
        if any(MARKER in pieces[i].lstrip(MARKER) for i in keys):
            raise ValueError("a piece reaches across a word's start")

    @classmethod
    def load(cls, path: str) -> UnigramModel:
        """Pieces and scores of a SentencePiece model file, whatever algorithm made them."""
        return cls.of(sentencepiece.SentencePieceProcessor(model_file=path))

    @classmethod
    def of(cls, p: sentencepiece.SentencePieceProcessor) -> UnigramModel:
        n = p.get_piece_size()
        ordinary = [not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)) for i in range(n)]
        in_bytes = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        in_bytes = in_bytes if all(p.is_byte(i) for i in in_bytes) else []
        return cls([p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)], ordinary, in_bytes, p.unk_id())

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, markers included, as the best path through it."""
        out: list[np.ndarray] = [None] * len(words)
        raw = [w.encode() for w in words]
        order = sorted(range(len(words)), key=lambda i: len(raw[i]))
        while order and len(raw[order[-1]]) > LONG_BYTES:
            i = order.pop()
            out[i] = self._long(raw[i])
        at = 0
        while at < len(order):  # words of like length together, in tables of bounded size
            size = max(1, min(BATCH_WORDS, TABLE_CELLS // (len(raw[order[at]]) + 1)))
            while size > 1 and size * (len(raw[order[min(at + size, len(order)) - 1]]) + 1) > TABLE_CELLS:
                size //= 2
            some = order[at : at + size]
            for i, ids in zip(some, self._viterbi([raw[i] for i in some])):
                out[i] = ids
            at += size
        return out

    def _viterbi(self, raw: list[bytes]) -> list[np.ndarray]:
        n = len(raw)
        length = np.array([len(r) for r in raw])
        width = int(length.max()) if n else 0
        text = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        text[np.arange(width + 1)[None, :] < length[:, None]] = flat
        starts = (text & 0xC0) != 0x80  # first bytes of code points
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        rows = np.arange(n)
        for s in range(width):
            live = rows[(s < length) & starts[:, s]]
            if not len(live):
                continue
            score = best[live, s]
            node = np.zeros(len(live), np.int32)
            # The end of this code point, for the unknown piece where no piece ends there.
            lead = text[live, s]
            char = 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)
            single = np.zeros(len(live), bool)
            active, depth = np.arange(len(live)), 0
            while len(active):
                inside = s + depth < length[live[active]]
                active = active[inside]
                step = self.trie.step(node[active], text[live[active], s + depth])
                active, step = active[step >= 0], step[step >= 0]
                node[active] = step
                depth += 1
                value = self.trie.value[step]
                hit = active[value >= 0]
                if len(hit):
                    ids, at = value[value >= 0], live[hit]
                    single[hit] |= char[hit] == depth
                    new = score[hit] + self.scores[ids]
                    better = (new > best[at, s + depth]) | (piece[at, s + depth] == -1)
                    at, ids, new = at[better], ids[better], new[better]
                    best[at, s + depth], back[at, s + depth], piece[at, s + depth] = new, s, ids
            none = np.flatnonzero(~single)
            if len(none):
                at, end = live[none], s + char[none]
                new = score[none] + self.unknown_score
                better = (new > best[at, end]) | (piece[at, end] == -1)
                at, end, new = at[better], end[better], new[better]
                best[at, end], back[at, end], piece[at, end] = new, s, self.unknown
        # Back from the ends, all words together, then turned round.
        steps, here = [], length.copy()
        while (here > 0).any():
            p = np.where(here > 0, piece[rows, here], -1)
            before = np.where(here > 0, back[rows, here], 0)
            steps.append((p, before, here))
            here = before
        out = []
        if not steps:
            return [np.array([], np.int32) for _ in raw]
        ids = np.stack([p for p, _, _ in steps][::-1], axis=1)
        unknown = ids == self.unknown
        for i in range(n):
            row = ids[i][ids[i] >= 0]
            if unknown[i].any():
                row = self._fallback(raw[i], [(p[i], b[i], e[i]) for p, b, e in reversed(steps) if p[i] >= 0])
            out.append(row.astype(np.int32))
        return out

    def _long(self, raw: bytes) -> np.ndarray:
        """The same for one long word: the trie is walked from many places at once, then the path is found place by place."""
        n = len(raw)
        text = np.frombuffer(raw, np.uint8)
        best, back, piece = array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        for begin in range(0, n, STARTS):
            some = text[begin : begin + STARTS]
            starts = begin + np.flatnonzero((some & 0xC0) != 0x80)  # first bytes of code points
            lead = text[starts]
            char = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
            node, active, depth = np.zeros(len(starts), np.int32), np.arange(len(starts)), 0
            found = []
            while len(active):
                active = active[starts[active] + depth < n]
                step = self.trie.step(node[active], text[starts[active] + depth])
                active, step = active[step >= 0], step[step >= 0]
                node[active] = step
                depth += 1
                value = self.trie.value[step]
                hit = value >= 0
                found.append((active[hit], np.full(int(hit.sum()), depth), value[hit]))
            who, size, ids = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in range(3))
            order = np.argsort(who, kind="stable")  # by place, shorter pieces first
            who, size, ids = who[order], size[order], ids[order]
            single = np.zeros(len(starts), bool)
            single[who[size == char[who]]] = True
            first = np.searchsorted(who, np.arange(len(starts) + 1)).tolist()
            size, gain, ids = size.tolist(), self.scores[ids].tolist(), ids.tolist()
            for k, (s, c, known) in enumerate(zip(starts.tolist(), char.tolist(), single.tolist())):
                score = best[s]
                for j in range(first[k], first[k + 1]):
                    end, new = s + size[j], score + gain[j]
                    if new > best[end] or piece[end] == -1:
                        best[end], back[end], piece[end] = new, s, ids[j]
                if not known:
                    end, new = s + c, score + self.unknown_score
                    if new > best[end] or piece[end] == -1:
                        best[end], back[end], piece[end] = new, s, self.unknown
        path, here = [], n
        while here > 0:
            path.append((piece[here], back[here], here))
            here = back[here]
        return self._fallback(raw, path[::-1])

    def _fallback(self, raw: bytes, path: list[tuple]) -> np.ndarray:
        ids: list[int] = []
        for p, begin, end in path:
            if p != self.unknown:
                ids.append(int(p))
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in raw[begin:end]]
            elif ids[-1:] != [self.unknown]:  # a run of unknown characters is one piece
                ids.append(self.unknown)
        return np.array(ids, np.int32)

    def decode(self, ids) -> str:
        """The text of ids: bytes joined to characters, markers to spaces, the first one dropped."""
        table = self.written
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text.removeprefix(MARKER).replace(MARKER, " ")


@lru_cache(maxsize=2)
def _model(path: str) -> UnigramModel:
    return UnigramModel.load(path)


def split_words(text: str) -> list[str]:
    """The words of a text with markers for spaces, a marker put in front; an empty text has none."""
    return _WORD.findall(MARKER + text.replace(" ", MARKER)) if text else []


class Encoder:
    """Encodes texts; each distinct word once, as long as it is remembered."""

    def __init__(self, model: UnigramModel, cache: int = CACHE_WORDS):
        self.model = model
        self.words: dict[str, bytes] = {}
        self.cache = cache

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > self.cache:
            self.words.clear()
        split = [split_words(t) for t in texts]
        ids = self.words
        new = [w for w in set().union(*split) if w not in ids]
        for w, found in zip(new, self.model.encode_words(new)):
            ids[w] = found.astype("<u4").tobytes()
        return [b"".join([ids[w] for w in words]) for words in split]


def _groups(texts: list[str]) -> Iterator[list[str]]:
    some, chars = [], 0
    for t in texts:
        if some and chars + len(t) > BLOCK_CHARS:
            yield some
            some, chars = [], 0
        some.append(t)
        chars += len(t)
    if some:
        yield some


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(`doc_id`, `ids`) for every row of `docs` (`doc_id`, `text`): packed little-endian 32-bit ids.

    Null and empty texts have no ids. Repeated rows give a row each, null ids
    too; an empty table gives an empty result; other columns are ignored.
    """

    model = _model(path)  # built once; tasks receive it, bounded by the pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [x for some in _groups(texts) for x in encoder.encode_many(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(`doc_id`, `text`) for every row of `rows` (`doc_id`, `ids`).

    Null ids give a null text, no ids an empty one. Rows that repeat give a
    row each; an empty table gives an empty result; other columns are ignored.
    """

    model = _model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [None if x is None else model.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


_REPORT = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_tokens", "ids_crc32", "n_byte_tokens", "decoded_crc32")] + [("round_trip", pa.bool_())])


def encoding_report(docs: DataFrame, path: str) -> DataFrame:
    """Per row of `docs` (`doc_id`, `text`) what its ids and the text decoded from them are like.

    `n_tokens`, `ids_crc32` of the packed ids, `n_byte_tokens` (pieces of byte
    fallback), `decoded_crc32` of the decoded text in UTF-8, all checksums
    unsigned, and `round_trip`: whether that text is the input, which it is
    not if the text has markers of its own. Null and empty texts: 0 tokens,
    the checksum of nothing, true. See `encoded` for the rest.
    """

    model = _model(path)
    is_byte = np.zeros(len(model.pieces), bool)
    is_byte[model.byte_ids] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for some in _groups(texts):
                for text, packed in zip(some, encoder.encode_many(some)):
                    ids = np.frombuffer(packed, "<u4")
                    again = model.decode(ids.tolist())
                    rows.append((len(ids), zlib.crc32(packed), int(is_byte[ids].sum()), zlib.crc32(again.encode()), again == text))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ((),) * 5, list(_REPORT)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=_REPORT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_crc32 long, n_byte_tokens long, decoded_crc32 long, round_trip boolean"
    )
