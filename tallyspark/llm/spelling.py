"""Spelling variants of words, found by a variable-length gram index (Li, Wang and Yang 2007).

The dictionary holds all grams of the least length, and a longer gram only
where its prefix is frequent, so that frequent grams are told apart by what
follows. A word is decomposed into the longest grams of the dictionary at each
place, less those inside an earlier one. For each word a bound is computed on
the grams that one edit can affect; all others are grams of its near words
too. So of any `bound + 1` grams one at least is shared, and a word merges the
lists of just these, the shortest ones. A list holds words of one length with
the gram at one place, and the same letters on the side that the edit is not
on. What the lists give is verified by edit distance.

Words are counted in each task before they are shuffled.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import cut, slices, written

#: A run's code point is dropped where this divides its hash.
DROP_EVERY = 199
MIN_LETTERS = 6
MIN_COUNT = 5
#: A word's form occurs at least so many times as often.
FORM_RATIO = 5
MIN_GRAM = 2
MAX_GRAM = 3
#: A gram is frequent if it occurs more often than this share of the number of words. So grams that
#: are extended are at most (mean length / share) of each length, whatever the number of words.
FREQUENT = 0.001
#: Distinct words that a task counts before it passes the counts on.
HELD_WORDS = 200_000

_runs = re.compile("[A-Za-zÀ-ÿ]+").findall
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words_of(doc_id: int | None, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of a text of at least `MIN_LETTERS`, and how often; without an id no code point is dropped."""
    prefix = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
    for run, n in Counter(_runs((text or "").translate(_LOWER))).items():
        if prefix is not None:
            h = zlib.crc32(run.encode(), prefix)
            if h % DROP_EVERY == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
        if len(run) >= MIN_LETTERS:
            yield run, n


def word_counts(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(`word`, `n`) of all words of `docs` (`doc_id`, `text`) that occur `min_count` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, n in words_of(doc_id, text):
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield counted()
                    held.clear()
        if held:
            yield counted()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


class GramDictionary:
    """Decomposes words, and bounds the grams that one edit affects."""

    def __init__(self, grams: Iterable[str], min_gram: int = MIN_GRAM, max_gram: int = MAX_GRAM):
        self.grams = frozenset(grams)
        self.min, self.max = min_gram, max_gram
        self.extended = frozenset(g[:-1] for g in self.grams)
        # What a match can run through: grams and their first letters, whole and with any one letter open.
        self.paths = self.grams | {g[:k] for g in self.grams for k in range(1, min_gram)}
        self.open = frozenset((p[:k], p[k + 1 :]) for p in self.paths for k in range(len(p)))

    def decompose(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the word's grams. A pair of letters outside the dictionary is a gram too."""
        out, reached = [], 0
        for at in range(len(word) - self.min + 1):
            end = at + self.min
            while end - at < self.max and end < len(word) and word[at : end + 1] in self.grams:
                end += 1
            if end > reached:
                out.append((at, end))
                reached = end
        return out

    def _covered(self, word: str, edit: int, skip: int, wild: bool, end: int) -> bool:
        """Whether a match that starts at the edit or before can come to cover a gram behind it that ends at `end`.

        The edit puts any letter (`wild`) for the `skip` letters at `edit`.
        """
        rest = word[edit + skip : end]
        for at in range(max(0, end - skip + wild - self.max), edit + wild):
            path = word[at:edit]
            if (path, rest) in self.open if wild else path + rest in self.paths:
                return True
        return False

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """A bound on how many of the word's `grams` one edit can take away.

        An edit takes away the grams that it lies in, those that it lets grow
        at their end, and those that a match from before comes to cover.
        """
        grows = [e - s < self.max and word[s:e] in self.extended for s, e in grams]
        most = first = 0
        for at in range(len(word) + 1):
            while first < len(grams) and grams[first][1] < at:
                first += 1
            replaced = deleted = inserted = 0
            for k in range(first, len(grams)):
                start, end = grams[k]
                if start > at + self.max:
                    break
                if at < len(word):
                    if start <= at < end:
                        replaced += 1
                        deleted += 1
                    elif at == end:
                        replaced += grows[k]
                        deleted += grows[k] and word[start:end] + word[at + 1 : at + 2] in self.grams
                    elif at < start:
                        replaced += self._covered(word, at, 1, True, end)
                        deleted += self._covered(word, at, 1, False, end)
                if start < at < end:
                    inserted += 1
                elif at == end:
                    inserted += grows[k]
                elif at <= start:
                    inserted += self._covered(word, at, 0, True, end)
            most = max(most, replaced, deleted, inserted)
        return most


def gram_dictionary(words: DataFrame, min_gram: int = MIN_GRAM, max_gram: int = MAX_GRAM, frequent: float = FREQUENT) -> GramDictionary:
    """The dictionary of `words` (`word`). Its size is bounded, see `FREQUENT`; it goes to the driver and to every task."""
    letters = F.char_length("word")
    lengths = F.array(*(F.lit(k) for k in range(min_gram, max_gram + 1)))
    grams = (
        words.select("word", F.explode(lengths).alias("k"))
        .where(letters >= F.col("k"))
        .select("word", "k", F.explode(F.sequence(F.lit(1), letters - F.col("k") + 1)).alias("at"))
        .select(F.substring("word", F.col("at"), F.col("k")).alias("gram"), "k")
        .groupBy("gram", "k")
        .agg(F.count("*").alias("n"))
    )
    grams = written(grams, "spelling-grams")
    least = max(1.0, words.count() * frequent)
    found = [r.gram for r in grams.where(F.col("k") == min_gram).select("gram").collect()]
    for k in range(min_gram + 1, max_gram + 1):
        # A gram is in the dictionary if its prefix is and is frequent.
        kept = grams.where((F.col("k") == k - 1) & (F.col("n") > least)).select(F.col("gram").alias("prefix"))
        some = grams.where(F.col("k") == k).withColumn("prefix", F.expr(f"substring(gram, 1, {k - 1})"))
        short = set(found)
        found += [r.gram for r in some.join(kept, "prefix", "left_semi").select("gram").collect() if r.gram[:-1] in short]
    return GramDictionary(found, min_gram, max_gram)


_MODULUS = (1 << 61) - 1


def _running(letters: Iterable[str]) -> list[int]:
    """Hashes of all prefixes of `letters`, the empty one first."""
    out, h = [1], 1
    for c in letters:
        h = (h * 1_000_003 + ord(c) + 1) % _MODULUS
        out.append(h)
    return out


def _key(*parts: int) -> int:
    h = 7
    for p in parts:
        h = (h * 6_364_136_223_846_793_005 + p + 1) % _MODULUS
    return h


_ROWS = "word string, n long, gram int, keep int, own long, down long, up long"
#: In place of a gram's number: half a word.
HALF = -1


def index_rows(words: DataFrame, grams: GramDictionary) -> DataFrame:
    """The lists that each word of `words` (`word`, `n`) is in: two rows per gram, one for each side of it.

    `own` is the list of the word's own length, `down` and `up` those of words
    one letter shorter and longer. `keep` is how many grams it must look up.
    Where the bound leaves no gram that is certainly shared, `keep` is 0, and
    two rows more, with the halves of the word, find other such words.
    """

    def rows(word: str, n: int) -> Iterator[tuple]:
        size = len(word)
        front, back = _running(word), _running(reversed(word))
        found = grams.decompose(word)
        bound = grams.affected(word, found)
        keep = bound + 1 if bound < len(found) else 0
        for k, (start, end) in enumerate(found):
            # The edit is behind the gram, or in front of it.
            a, b = front[end], back[size - start]
            yield word, n, k, keep, *(_key(size + d, 0, start, a) for d in (0, -1, 1))
            yield word, n, k, keep, *(_key(size + d, 1, end + d, b) for d in (0, -1, 1))
        if not keep:
            for side, hashes in ((2, front), (3, back)):
                # The front half of the shorter word, and its back half.
                half = size // 2 if side == 2 else size - size // 2
                lower = (size - 1) // 2 if side == 2 else size - 1 - (size - 1) // 2
                yield word, n, HALF, keep, _key(size, side, hashes[half]), _key(size - 1, side, hashes[lower]), None

    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("gram", pa.int32()), ("keep", pa.int32())] + [(c, pa.int64()) for c in ("own", "down", "up")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            found = [r for w, n in zip(*(c.to_pylist() for c in batch.columns)) for r in rows(w, n)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return words.select("word", "n").mapInArrow(run, _ROWS)


def near_pairs(words: DataFrame, grams: GramDictionary) -> DataFrame:
    """(`a`, `n_a`, `b`, `n_b`): the pairs of `words` (`word`, `n`) at edit distance 1, each once, in one order."""
    rows = written(index_rows(words, grams), "spelling-index")
    sizes = rows.groupBy("own").agg(F.count("*").alias("size"))
    sized = rows.where("keep > 0").join(sizes, "own").repartition("word")
    cost = F.sum("size").over(Window.partitionBy("word", "gram"))
    rank = F.dense_rank().over(Window.partitionBy("word").orderBy("cost", "gram"))
    chosen = sized.withColumn("cost", cost).withColumn("rank", rank).where("rank <= keep").drop("size", "cost", "rank")
    chosen = written(chosen.unionByName(rows.where(F.col("gram") == HALF)), "spelling-lookups")

    lists = rows.select(F.col("own").alias("list"), F.col("word").alias("b"), F.col("n").alias("n_b"), (F.col("keep") == 0).alias("mute"))
    ask = [F.struct(F.col("own").alias("list"), F.lit(True).alias("same")), F.struct(F.col("down").alias("list"), F.lit(False).alias("same"))]
    asked = chosen.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.explode(F.array(*ask)).alias("ask")).select("a", "n_a", "ask.*")
    # Of two words that both ask, the longer asks, or the lesser; a word without a bound does not ask, save by its halves.
    found = asked.join(lists, "list").where("not same or a < b or mute")
    longer = chosen.where(F.col("gram") != HALF).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("up").alias("list"))
    found = found.select("a", "n_a", "b", "n_b").unionByName(longer.join(lists.where("mute"), "list").select("a", "n_a", "b", "n_b"))
    found = found.where(F.levenshtein("a", "b", 1) == 1)
    swap = F.col("a") > F.col("b")
    ordered = [F.when(swap, F.col(x)).otherwise(F.col(y)) for x, y in (("b", "a"), ("n_b", "n_a"), ("a", "b"), ("n_a", "n_b"))]
    return found.select(*(c.alias(x) for c, x in zip(ordered, ("a", "n_a", "b", "n_b")))).distinct()


def _roots(forms: DataFrame, most: int, ratio: float) -> DataFrame:
    """(`_word`, `root`): the last word that forms lead to from each word of `forms` (`word`, `form`).

    Each step multiplies the count by `ratio` at least, so that steps are few;
    each round doubles the steps taken.
    """
    steps = max(1, math.ceil(math.log(max(most, 2), ratio)))
    at = cut(forms.select(F.col("word").alias("_word"), F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = at.select(F.col("_word").alias("_via"), F.col("root").alias("_next"))
        at = cut(at.join(ahead, at["root"] == ahead["_via"], "left").select("_word", F.coalesce("_next", "root").alias("root")))
    return at


def spelling_variants(
    docs: DataFrame, min_count: int = MIN_COUNT, ratio: float = FORM_RATIO, min_gram: int = MIN_GRAM,
    max_gram: int = MAX_GRAM, frequent: float = FREQUENT,
) -> DataFrame:
    """(`word`, `form`, `root`, `n`, `n_near`, `form_n`) of the words of `docs` (`doc_id`, `text`).

    A word's form is the most frequent of its near words, if that occurs
    `ratio` times as often or more; ties go to the first in code-point order.
    Null and empty texts have no words. Repeated rows count each. In rows
    without an id no code point is dropped. An empty table gives an empty
    result. Other columns are ignored.
    """
    if ratio <= 1:
        raise ValueError("ratio > 1")
    words = written(word_counts(docs, min_count), "spelling-words")
    near = near_pairs(words, gram_dictionary(words, min_gram, max_gram, frequent))
    ends = F.explode(F.array(
        F.struct(F.col("a").alias("_word"), F.col("b").alias("other"), F.col("n_b").alias("n")),
        F.struct(F.col("b").alias("_word"), F.col("a").alias("other"), F.col("n_a").alias("n")),
    ))
    best = near.select(ends.alias("e")).select("e.*").groupBy("_word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best")
    )
    near_n = -F.col("best.n")
    formed = near_n >= ratio * F.col("n")
    found = words.join(best, words["word"] == best["_word"], "left").select(
        "word", F.when(formed, F.col("best.other")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, near_n).alias("form_n"),
    )
    found = written(found, "spelling-forms")
    most = found.agg(F.max("n")).first()[0] or 1
    roots = _roots(found.where("form is not null"), most, ratio)
    return found.join(roots, found["word"] == roots["_word"], "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
