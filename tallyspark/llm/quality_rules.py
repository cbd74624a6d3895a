"""Quality rules: text statistics, and lines that many documents of a host share.

Everything is DataFrame code. The statistics are array expressions inside one
row, so no word leaves its document. The lines of a document become rows of
hashes; only these are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import SPACE, WORD, words, written

#: A line is boilerplate if so many different texts of one host have it, and more than this share of them.
MIN_DOCUMENTS = 3
MIN_SHARE = 0.02
#: A document that keeps less than this share of its words is depleted.
MIN_KEPT_PERCENT = 70
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash is found twice or more.

    `windows` are (hash, position) structs in order, so that equal hashes are neighbours.
    """
    twice = F.filter(
        windows,
        lambda e, k: (e["h"] == F.get(windows, k - 1)["h"]) | (e["h"] == F.get(windows, k + 1)["h"]),
    )
    at = F.sort_array(F.transform(twice, lambda e: e["i"]))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        at,
        zero,
        lambda a, x: F.struct(
            (a["n"] + x + 3 - F.greatest(x, a["end"])).alias("n"), (x + 3).alias("end")
        ),
        lambda a: a["n"],
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row per document: `_id`, `_text_hash`, `_host`, the statistics and `base_failed`.

    A null text counts as empty, a null host as the host "".
    """
    text = F.coalesce("text", F.lit(""))
    df = docs.select(
        F.col("doc_id").alias("_id"),
        F.coalesce("source", F.lit("")).alias("_host"),
        text.alias("_text"),
        words(text).alias("_w"),
    )
    window = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    df = df.withColumn("_h", F.when(F.size("_w") >= 3, window))
    pairs = F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(
        "_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(pairs))
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))
    df = df.withColumn("_l", lines)
    df = df.select(
        "_id",
        "_host",
        F.xxhash64("_text").alias("_text_hash"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", "")))
        .cast("long")
        .alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(_repeated_words(F.col("_s")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return df.withColumn("base_failed", failed)


def counted_lines(docs: DataFrame) -> DataFrame:
    """Every line with a word, as hashes: no text in the rows. Each document has a row more, without a line."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select(
        F.col("doc_id").alias("_id"),
        F.coalesce("source", F.lit("")).alias("_host"),
        F.xxhash64(text).alias("_text_hash"),
        F.posexplode(F.array_append(F.split(text, "\n"), F.lit(None).cast("string"))).alias("_pos", "_line"),
    ).withColumn("_line", _normal(F.col("_line")))
    none = F.col("_line").isNull()
    return df.where(none | (F.col("_line") != "")).select(
        "_id",
        "_host",
        "_text_hash",
        "_pos",
        F.when(~none, F.xxhash64("_line")).alias("_line_hash"),
        F.size(F.split("_line", " ")).alias("_line_words"),
    )


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(`_host`, `_line_hash`) of lines that many texts of a host have.

    At least `min_documents` different texts, and more than `min_share` of the
    host's different texts. Copies of a text count once. The text hash is part
    of the first key, so a line that a third of all documents share is counted
    in many tasks. The rows without a line count the texts of each host.
    """
    each = lines.groupBy("_host", "_line_hash", "_text_hash").agg(F.lit(1).alias("_one"))
    counts = each.groupBy("_host", "_line_hash").agg(F.count("_one").alias("_documents"))
    none = F.col("_line_hash").isNull()
    # Written, so that the sizes are known: where few hosts are, they are broadcast.
    counts = written(counts.where(none | (F.col("_documents") >= min_documents)), "line-counts")
    hosts = counts.where(none).select(F.col("_host").alias("_of"), F.col("_documents").alias("_texts"))
    found = counts.where(~none)
    return found.join(hosts, found["_host"] == hosts["_of"]).where(
        F.col("_documents") > F.lit(min_share) * F.col("_texts")
    ).select("_host", "_line_hash")


def removed_words(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """Removed lines of documents that have any: `_id`, `_host`, `_text_hash`, `n_removed_words`, `_removed`.

    `_removed` are the positions of the lines, counted from 0, in no order.
    """
    lines = counted_lines(docs)
    # Written, so that its size is known: a small one is broadcast; beside a large one Spark splits hot lines.
    shared = written(shared_lines(lines, min_documents, min_share), "shared-lines")
    hit = lines.join(shared, ["_host", "_line_hash"])
    key = ["_id", "_host", "_text_hash"]
    once = hit.groupBy(*key, "_pos").agg(F.max("_line_words").alias("_n"))
    return once.groupBy(*key).agg(
        F.sum("_n").alias("n_removed_words"), F.collect_list("_pos").alias("_removed")
    )


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (
        a["_id"].eqNullSafe(b["_id"])
        & (a["_host"] == b["_host"])
        & (a["_text_hash"] == b["_text_hash"])
    )


def quality_rules(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_share: float = MIN_SHARE,
    min_kept_percent: int = MIN_KEPT_PERCENT,
) -> DataFrame:
    """One row per row of `docs` (`doc_id`, `text`, `source`): statistics and verdict.

    `kept` is false if the base rules fail, or if the lines that at least
    `min_documents` different texts of the host have, and more than `min_share`
    of them, leave less than `min_kept_percent` of the words. Null text: empty,
    so it fails on too few words. Null source: the host "". Repeated rows: a row each. An empty table
    gives an empty result. Other columns of `docs` are ignored.
    """
    stats = text_statistics(docs)
    removed = removed_words(docs, min_documents, min_share)
    joined = stats.join(removed, _same(stats, removed), "left")
    n_removed = F.coalesce(removed["n_removed_words"], F.lit(0))
    left = F.col("n_words") - n_removed
    return joined.select(
        stats["_id"].alias("doc_id"),
        *(
            stats[c]
            for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        ),
        n_removed.alias("n_removed_words"),
        stats["base_failed"],
        (
            ~stats["base_failed"] & (100 * left >= min_kept_percent * F.col("n_words"))
        ).alias("kept"),
        stats["_host"],
        stats["_text_hash"],
        removed["_removed"],
    )


def _without(text: Column, removed: Column) -> Column:
    """`text` without the lines at the positions `removed`."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")


def keep_documents(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of `docs` that the rules keep, their `text` without the removed lines.

    The rules judge the text as it was. A column `n_chars` counts the code
    points that are left where lines went; other columns, and texts without a
    removed line, stay as they are. Null and empty texts go, since they have
    too few words. Rows that repeat stay or go together. An empty table gives
    an empty result. Only keys and positions are joined, so texts move once at
    most.
    """
    verdict = quality_rules(docs, **limits)
    edits = (
        verdict.where(~F.col("kept") | F.col("_removed").isNotNull())
        .select(F.col("doc_id").alias("_id"), "_host", "_text_hash", F.col("kept").alias("_keep"), "_removed")
        .dropDuplicates(["_id", "_host", "_text_hash"])
    )
    same = (
        docs["doc_id"].eqNullSafe(edits["_id"])
        & (F.coalesce(docs["source"], F.lit("")) == edits["_host"])
        & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == edits["_text_hash"])
    )
    edited = edits["_removed"].isNotNull()
    text = F.when(edited, _without(docs["text"], edits["_removed"])).otherwise(docs["text"])
    joined = docs.join(edits, same, "left").where(F.coalesce(edits["_keep"], F.lit(True)))

    def column(c: str) -> Column:
        if c == "n_chars":
            return F.when(edited, F.char_length(text)).otherwise(docs[c]).cast(docs.schema[c].dataType)
        return text if c == "text" else docs[c]

    return joined.select(*(column(c).alias(c) for c in docs.columns))
