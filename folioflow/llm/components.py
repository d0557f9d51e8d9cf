"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.lineage import shuffles_removed

from .common import checkpointed


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _with_least(pairs: DataFrame) -> DataFrame:
    """Adds m, the least of a and its neighbours."""
    least = pairs.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("of"), F.least("a", "low").alias("m"))
    return pairs.join(least, F.col("a") == F.col("of")).select("a", "b", "m")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node that can be reached) of every node but the roots in a link table (a long, b long).

    Alternates the large-star and small-star steps until the links no longer change; each round's links are
    written to the checkpoint folder, so that a lost executor costs at most one round. Links from a node to
    itself are allowed and say nothing; an empty table gives an empty result.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        with shuffles_removed(edges.sparkSession):
            mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        large = _with_least(_both_ways(edges)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = _with_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = down.select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.where("a <> b").distinct())
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
