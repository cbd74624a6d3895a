"""Row-set operators that hold up when one key has very many rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the lowest by `order`, nulls last, then by the other columns, nulls last.

    An aggregate rather than row_number: each task reduces its own copies
    before the shuffle, so a hot key sends one row per task. The struct that
    ranks a row is the row, so a group's state holds each column once.
    """
    rest = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    if not rest:
        return df.distinct()
    ranked = [x for c in rest for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))]
    first = df.groupBy(*keys).agg(F.min(F.struct(*ranked)).alias("_row"))
    at = {c: 2 * k + 1 for k, c in enumerate(rest)}
    names = first.schema["_row"].dataType.names
    return first.select(*[c if c in keys else F.col("_row")[names[at[c]]].alias(c) for c in df.columns])


def unseen(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `new` whose key is not in `existing`, one per key: a load that can be repeated.

    Null keys are equal to each other. Both sides are reduced per key in each
    task first, so that neither a hot key nor raw rows reach the join.
    """
    once = keep_first(new, keys)
    known = existing.groupBy(*[F.col(k).alias(f"_known_{k}") for k in keys]).agg(F.lit(True).alias("_known"))
    same = reduce(and_, [once[k].eqNullSafe(known[f"_known_{k}"]) for k in keys])
    return once.join(known, same, "left_anti")


def profile_columns(df: DataFrame) -> DataFrame:
    """Row, null and distinct counts of every column; zeros for an empty table.

    Counting per (column, value) first spreads a wide table over all
    tasks; the second step then only adds up partial sums per column.
    """
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    counted = (
        text.unpivot([], text.columns, "column_name", "value")
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = counted.groupBy("column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("value").alias("distinct_count"),
    )
    every = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column_name string")
    return every.join(found, "column_name", "left").na.fill(0)
