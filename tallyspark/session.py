"""Session and checkpoint settings."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shared: str | None = None) -> SparkSession:
    """Session for tests and the bench, `shared` its checkpoint folder; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallyspark")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    return builder.getOrCreate()


def checkpoint_path(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """Folder for `name` under the shared checkpoint folder of the cluster.

    `fallback` is for tests, where spark.checkpoint.dir is unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if root is None:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return f"{root.rstrip('/')}/{name}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder; whoever runs the job clears that folder.

    Where no checkpoint folder is set and Spark runs in one process, as in
    tests, the warehouse folder serves. On a cluster an unset folder raises:
    executors would write where others cannot read.
    """
    master = spark.sparkContext.master
    alone = master == "local" or master.startswith("local[")
    fallback = spark.conf.get("spark.sql.warehouse.dir") if alone else None
    return checkpoint_path(spark, f"{name}-{uuid.uuid4().hex}", fallback)
