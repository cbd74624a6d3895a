"""Reports over the given tables. No broadcast hints: Spark picks one from
the measured size, or shuffles; an inner join then splits hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.money import cents
from tallyspark.operators.periods import with_change
from tallyspark.operators.rows import keep_first, profile_columns, unseen
from tallyspark.session import scratch_path
from tallyspark.sources.tables import checked_csv, read_table
from tallyspark.streaming.windows import event_windows


def monthly_segment_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey",
        F.trunc("o_orderdate", "month").alias("month"),
        cents(F.col("o_totalprice")).alias("cents"),
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    totals = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_mktsegment").alias("segment"), "month")
        .agg(F.count(F.lit(1)).alias("order_count"), F.sum("cents").alias("sales_cents"))
    )
    return with_change(totals, ["segment"], "month", "sales_cents").withColumn(
        "month", F.date_format("month", "yyyy-MM")
    )


def nation_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_customer = (
        read_table(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("o_totalprice"))).alias("cents"))
    )
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").join(
        read_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("n").alias("order_count"),
            F.sum("cents").alias("sales_cents"),
        )
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("r_name").alias("region"),
            F.col("n_name").alias("nation"),
            "customer_count",
            "order_count",
            "sales_cents",
        )
    )


def lineitem_first_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = keep_first(read_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return first.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def orders_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile_columns(read_table(spark, sf_dir, "orders"))


def _without(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    ordered = orders.select(F.col("o_custkey").alias("c_custkey"))
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return unseen(customer, ordered, ["c_custkey"])


def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without(spark, sf_dir, read_table(spark, sf_dir, "orders"))


def customers_without_open_urgent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders")
    return _without(spark, sf_dir, orders.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = event_windows(read_table(spark, sf_dir, "events"), late=None)
    at = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("window_start", "window_end")]
    return windows.select(*at, *windows.columns[2:])


def orders_csv_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders through CSV files, pending ones without a price: good and rejected lines by status and reason."""
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
    )
    path = f"{scratch_path(spark, 'orders-csv')}/csv"
    orders.write.option("header", True).csv(path)
    checked = checked_csv(spark, path, {"o_orderkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double"})
    status = F.coalesce("o_orderstatus", "reject.texts.o_orderstatus").alias("status")
    return checked.groupBy(status, F.col("reject.reason").alias("reason")).agg(
        F.count(F.lit(1)).alias("line_count"), F.sum(cents(F.col("o_totalprice"))).alias("sales_cents")
    )
