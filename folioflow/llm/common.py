"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.lineage import shuffles_removed

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"

#: The word of every contract, as a Python regular expression.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


#: Rows and bytes of the Arrow batches that go to Python workers; long texts would make Spark's own defaults large.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the text's words; null and blank texts give an empty array."""
    flat = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for a row's id and text, so that rows which share an id stay apart."""
    return F.concat_ws(
        "-",
        F.hex(F.xxhash64(doc_id, text)),
        F.hex(F.xxhash64(F.lit(7), text, doc_id)),
    )


def prepare_checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a folder of our own only where none is set and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder."""
    prepare_checkpoints(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint()


def small_batches(docs: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are bounded by ``BATCH_ROWS`` and ``BATCH_BYTES`` from now on."""
    conf = docs.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(str(conf.get(key)).removesuffix("b"))
        if not 0 < now <= most:
            conf.set(key, str(most))
    return docs


#: Bytes of a group's rows from which :func:`release_after` gives memory back.
LARGE_GROUP = 4 << 20


def release_after(rows: pa.Table) -> None:
    """:func:`release` after a group of a task, if it was large: a collection takes longer than a small group's work."""
    if rows.nbytes >= LARGE_GROUP:
        release()


def release() -> None:
    """Give what a finished task held back to the system: a reused Python worker keeps freed memory else."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
