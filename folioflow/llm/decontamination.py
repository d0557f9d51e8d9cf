"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

An item's signature is a bottom-k MinHash sketch: the k smallest hashes of its distinct five-word
shingles. Items are partitioned by size (powers of two), and k is what the largest size of a partition
needs: of m shingles a document that holds at least 80 % misses at most m - ceil(0.8 m), so it holds one
of any m - ceil(0.8 m) + 1. No true pair is missed, however long the document. Documents' shingle hashes
meet the signatures in a hash join; pairs that share one are verified by counting shared shingles as text.

Only DataFrame functions are used. Words are runs of letters and digits in lower case. Defined results:
items of fewer than five words have no shingle and match nothing, nor do null or empty texts; of rows
that share a doc_id the fullest match is reported; equal items are reported each; an empty benchmark
gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, LEAST = 5, 0.8
#: Rows of the benchmark up to which its signatures and shingles are broadcast; beyond, they are shuffled.
BROADCAST_ITEMS = 20_000


def plain_words(text: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _windows(w: Column, make) -> Column:
    """make(the words of a shingle) for every shingle, in order."""
    nothing = F.slice(w, 1, 0)
    starts = F.when(F.size(w) >= SHINGLE, F.slice(w, 1, F.size(w) - SHINGLE + 1)).otherwise(nothing)
    return F.transform(starts, lambda x, i: make([x, *[F.get(w, i + k) for k in range(1, SHINGLE)]]))


def shingle_texts(w: Column) -> Column:
    return F.array_distinct(_windows(w, lambda ws: F.concat_ws(" ", *ws)))


def shingle_hashes(w: Column) -> Column:
    return _windows(w, lambda ws: F.xxhash64(*ws))


def item_signatures(benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """item_id, shingles (texts), n_item_shingles and signature (hashes) of every item with a shingle."""
    items = benchmark.select("item_id", plain_words(F.col("text")).alias("w"))
    items = items.select("item_id", shingle_texts(F.col("w")).alias("shingles"), F.sort_array(F.array_distinct(shingle_hashes(F.col("w")))).alias("hashes")).where(F.size("shingles") > 0)
    n = F.size("hashes")
    largest = F.pow(F.lit(2), F.floor(F.log2(n)) + 1).cast("int") - 1  # of the item's size partition
    k = largest - F.ceil(largest * least - 1e-9).cast("int") + 1
    return items.select("item_id", "shingles", F.size("shingles").cast("long").alias("n_item_shingles"), F.slice("hashes", 1, F.least(n, k)).alias("signature"))


def contained_items(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment of each pair with containment >= least."""
    items = item_signatures(benchmark, least)
    small = benchmark.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS
    sized = F.broadcast if small else (lambda x: x)
    signed = items.select(F.col("item_id").alias("item"), F.explode("signature").alias("hash"))
    found = docs.select("doc_id", plain_words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_hashes(F.col("w"))).alias("hash"))
    pairs = found.join(sized(signed), "hash").select(F.col("doc_id").alias("candidate_id"), "item").distinct()
    held = docs.select("doc_id", "text").join(pairs, F.col("doc_id").eqNullSafe(F.col("candidate_id")))
    held = held.select("doc_id", "item", plain_words(F.col("text")).alias("w")).select("doc_id", "item", shingle_texts(F.col("w")).alias("own"))
    checked = held.join(sized(items.select("item_id", "shingles", "n_item_shingles")), F.col("item").eqNullSafe(F.col("item_id")))
    shared = checked.select("doc_id", "item_id", "n_item_shingles", F.size(F.array_intersect("shingles", "own")).cast("long").alias("n_shared"))
    best = shared.groupBy("doc_id", "item_id", "n_item_shingles").agg(F.max("n_shared").alias("n_shared"))
    return best.where(F.col("n_shared") >= least * F.col("n_item_shingles") - 1e-9).withColumn("containment", F.round(F.col("n_shared") / F.col("n_item_shingles"), 6))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = LEAST) -> DataFrame:
    """The documents that contain no benchmark item."""
    bad = contained_items(docs, benchmark, least=least).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]), "left_anti")


ORACLE = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
bw AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM bw)),
n AS (SELECT item_id, count(*) AS n_item_shingles FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item_shingles, count(*) AS n_shared, round(count(*) / n_item_shingles, 6) AS containment
FROM s JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item_shingles HAVING count(*) >= 0.8 * n_item_shingles - 1e-9
"""
