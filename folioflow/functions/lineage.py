"""Cutting a plan's lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark removes the files of a query's shuffles when the query ends.
_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries on tables that are defined inside leave no shuffle files behind.

    Else these stay until the driver happens to collect its garbage, so that on a large heap a loop or a chain of steps
    keeps the shuffles of all its rounds on disk at once. What has been written to the checkpoint folder needs them no more.
    """
    before = spark.conf.get(_REMOVE, "false")
    spark.conf.set(_REMOVE, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE, before)


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder; one of our own only on a single machine where none is set."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    with shuffles_removed(spark):
        return df.select("*").checkpoint()
