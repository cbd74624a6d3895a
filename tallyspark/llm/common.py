"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.session import scratch_path as scratch

#: The word and space classes of the contracts, as Java and Python patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """`prefix`, with underscores put in front until no column of `df` begins with it."""
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = f"_{prefix}"
    return prefix


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows, a few at a time: Python objects take several times the memory of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words(text: Column) -> Column:
    """The words of a text, by the space class of the contracts."""
    return F.array_remove(F.split(text, SPACE), "")


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)
