"""Readers with a declared schema; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
        "l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by its declared schema; a declared column that the file lacks is an error."""
    path = f"{sf_dir}/{name}.parquet"
    declared = StructType.fromDDL(SCHEMAS[name])
    missing = sorted({f.name for f in declared} - set(spark.read.parquet(path).columns))
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return spark.read.schema(declared).parquet(path)


def checked_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Every line of CSV files by `columns` (name to type), in one scan, with a `reject` column.

    `reject` is null for good lines. For others it holds the `reason` (a wrong
    number of fields, or the columns whose text does not fit the type), the
    `file`, the raw `line` if its number of fields is wrong, and the `texts`
    of the columns. Every column is read as text and cast here, so a line is
    judged by all its columns even when a query reads few of them. A header
    that names other columns, or the same in another order, is an error.
    """
    reserved = {"reject"} & set(columns)
    if reserved:
        raise ValueError("reject is the name of the column that is added")
    line = "_line"
    while line in columns:
        line = f"_{line}"
    text = (
        spark.read.schema(StructType([StructField(c, StringType()) for c in [*columns, line]]))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", line)
        .csv(path)
    )
    raw = {c: F.col(f"`{c}`") for c in [*columns, line]}
    wrong = F.array_compact(
        F.array(*[F.when(raw[c].isNotNull() & raw[c].try_cast(t).isNull(), F.lit(c)) for c, t in columns.items()])
    )
    reason = F.when(raw[line].isNotNull(), F.lit("number of fields")).when(
        F.size(wrong) > 0, F.concat(F.lit("type of "), F.array_join(wrong, ", "))
    )
    texts = F.struct(*[raw[c].alias(c) for c in columns])
    reject = F.struct(
        reason.alias("reason"),
        F.col("_metadata.file_path").alias("file"),
        raw[line].alias("line"),
        texts.alias("texts"),
    )
    return text.select(
        *[raw[c].try_cast(t).alias(c) for c, t in columns.items()], F.when(reason.isNotNull(), reject).alias("reject")
    )


def read_csv(spark: SparkSession, path: str, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the rejects as text with `reject_reason`, `reject_file` and `reject_line`.

    Two views of `checked_csv`: a job that needs both writes that once instead.
    """
    checked = checked_csv(spark, path, columns)
    bad = checked.where(F.col("reject").isNotNull()).select(
        "reject.texts.*",
        F.col("reject.reason").alias("reject_reason"),
        F.col("reject.file").alias("reject_file"),
        F.col("reject.line").alias("reject_line"),
    )
    return checked.where(F.col("reject").isNull()).drop("reject"), bad
