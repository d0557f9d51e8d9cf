"""Layout tables derived from the documents, pages and order tables, so that every operator runs on data that grows.

Positions are a function of a word's number in its text: twelve words a row, fifty rows a page.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task turns into items: a word's row is about 40 times as large, and a task may sort several times.
TASK_BYTES = 4_000_000
WORDS_A_PAGE, WORDS_A_ROW, PAGE_WIDTH, PAGE_HEIGHT = 600, 12, 612.0, 792.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.lru_cache(maxsize=16)
def _tasks(spark: SparkSession, sf_dir: str) -> int:
    size = table(spark, sf_dir, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(math.ceil(size / TASK_BYTES), min(spark.sparkContext.defaultParallelism, math.ceil(size / 100_000)), 1)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt by doc_id: what is grouped by document or page later on is not shuffled as items, which are many times larger.

    Their number of parts is in proportion to the texts, as parts that adaptive execution sizes by the texts alone hold
    more items than a task can sort in memory. Joins by page or item may use this dealing, which holds for the session.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition(_tasks(spark, sf_dir), "doc_id")


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each space-parted token of a text, with a text matrix a-f."""
    tokens = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("seq", "str"))
    seq = F.col("seq")
    size = F.when(seq % WORDS_A_PAGE < WORDS_A_ROW, 18.0).otherwise(12.0)
    flat = (seq % 50 == 7) | (seq % 50 == 8)
    return tokens.select(
        "doc_id",
        F.floor(seq / WORDS_A_PAGE).cast("int").alias("page"),
        seq.cast("long").alias("seq"),
        "str",
        F.when(flat, 0.0).otherwise(size).alias("a"),
        F.lit(0.0).alias("b"),
        F.lit(0.0).alias("c"),
        F.when(flat, 0.0).otherwise(size).alias("d"),
        (72 + seq % WORDS_A_ROW * 40).cast("double").alias("e"),
        (720 - F.floor(seq % WORDS_A_PAGE / WORDS_A_ROW) * 14).cast("double").alias("f"),
        (5.0 * F.char_length("str")).alias("width"),
        F.when(seq % 50 == 8, 0.0).otherwise(-size).alias("height"),
        F.when(F.floor(seq / WORDS_A_ROW) % 7 == 0, "ABCDEF+Serif-Bold").otherwise("Serif").alias("font"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What :func:`pages_of` gives for the items of all documents, without a row for each item."""
    tokens = F.transform(F.split("text", " "), lambda t, i: F.when(t.rlike(r"\S"), F.floor(i / WORDS_A_PAGE).cast("int")))
    numbers = F.array_compact(F.array_distinct(tokens))
    return texts(spark, sf_dir).select("doc_id", F.explode(numbers).alias("page")).select("doc_id", "page", F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"))


def pages_of(items: DataFrame) -> DataFrame:
    return items.select("doc_id", "page").distinct().select("doc_id", "page", F.lit(PAGE_WIDTH).alias("page_width"), F.lit(PAGE_HEIGHT).alias("page_height"))


def redactions(pages: DataFrame) -> DataFrame:
    """One box a page (y_down is measured from the top)."""
    return pages.select("doc_id", "page", "page_height", (72 + F.col("doc_id") % 12 * 40).cast("double").alias("rx"), (72 + (F.col("doc_id") + F.col("page")) % 40 * 14).cast("double").alias("ry_down"), F.lit(80.0).alias("rw"), F.lit(28.0).alias("rh"))


def rules(pages: DataFrame) -> DataFrame:
    """A ruled grid on the pages of every fifth document; each upright line is drawn twice, a point apart."""
    pages = pages.where("doc_id % 5 = 0").select("doc_id", "page")
    flat = pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("k")).select("doc_id", "page", F.lit(70.0).alias("x"), (730.0 - 14 * F.col("k")).alias("y"), F.lit(480.0).alias("w"), F.lit(1.0).alias("h"))
    upright = pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("k")).select("doc_id", "page", (70.0 + 40 * F.floor(F.col("k") / 2) + F.col("k") % 2).alias("x"), F.lit(30.0).alias("y"), F.lit(1.0).alias("w"), F.lit(700.0).alias("h"))
    return flat.unionByName(upright)


def links(pages: DataFrame) -> DataFrame:
    """Three boxes a page, the last two overlapping."""
    k = F.col("ord")
    return pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ord")).select(
        "doc_id", "page", "ord", F.concat(F.lit("https://example.com/"), F.col("doc_id"), F.lit("/"), k).alias("url"),
        (72.0 + 40 * F.pmod(F.col("doc_id") + 3 * k, F.lit(10))).alias("lx"), (716.0 - 14 * F.pmod(F.col("page") + F.floor(k / 2), F.lit(8))).alias("ly"), F.lit(95.0).alias("lw"), F.lit(14.0).alias("lh"),
    )


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each text as paragraphs, twenty a page."""
    lines = texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    n = F.col("line")
    return lines.select("doc_id", n.cast("long").alias("ord"), F.floor(n / 20).cast("int").alias("page"), "text", (780.0 - 39 * (n % 20)).alias("y"), F.when(n % 20 == 1, 20.0).when(n % 7 == 3, 14.0).otherwise(10.0).alias("size"), F.lit(PAGE_HEIGHT).alias("page_height"))


def marked_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with list markers by their number."""
    k, n = F.col("ord") % 5, F.col("ord")
    mark = F.when(k == 0, F.lit("• ")).when(k == 1, F.concat(n, F.lit(". "))).when(k == 2, F.concat(F.lit("("), F.char(97 + (n % 26).cast("int")), F.lit(") "))).when(k == 3, F.lit("(iv) ")).otherwise("")
    return paragraphs(spark, sf_dir).withColumn("text", F.concat(mark, "text"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the pages of sources (customers)."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("page_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("position"), (F.col("o_orderkey") % 4 * 90).cast("int").alias("rotation"))
