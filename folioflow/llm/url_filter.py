"""Operator 8: URL rules behind a blocked Bloom filter.

Rules are listed canonical URLs (host and path) with a verdict. Each URL stands for the keys a rule could
have: every suffix of its host at a dot with every prefix of its path that is as long as some rule's path.
A blocked Bloom filter over the listed keys (one 64-bit block a key) passes possible hits; the exact hash
join with the list then removes false positives, and the longest rule left decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule, and gets the
verdict allow as every URL does that no rule fits; of rules that are equally long the first by text wins;
equal URLs are judged once and repeated rows are returned each; an empty list allows all.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict) of the production list.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Blocks of the filter a rule, and bits that a key sets in its block.
BLOCKS_PER_RULE, BITS = 2, 4
#: Most blocks of the filter, and listed rules, that are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path of a URL."""
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.char_length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column) -> Column:
    """Bits of a key inside its block."""
    h = F.xxhash64(F.lit("bits"), key)
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")))
    return mask


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of <key, size> that a rule which fits this URL could have."""
    labels = F.split(host, r"\.")
    suffixes = F.when(host != "", F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))
    prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row; rules has host, path and verdict."""
    host, path = url_parts(F.col("url"))
    listed = rules.select(F.concat("host", "path").alias("listed"), "verdict", F.char_length("path").alias("length"))
    lengths = sorted(r[0] for r in listed.select("length").distinct().collect())
    n = listed.count()
    sized = F.broadcast if n * BLOCKS_PER_RULE <= BROADCAST_ROWS else (lambda x: x)
    blocks = max(1, n * BLOCKS_PER_RULE)
    bloom = listed.groupBy(_block(F.col("listed"), blocks).alias("block")).agg(F.bit_or(_mask(F.col("listed"))).alias("bits"))
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct().select("url", host.alias("host"), path.alias("path"))
    keys = urls.select("url", F.explode(candidate_keys(F.col("host"), F.col("path"), lengths)).alias("key") if lengths else F.explode(F.array().cast("array<string>")).alias("key"))
    keys = keys.select("url", "key", _block(F.col("key"), blocks).alias("at"), _mask(F.col("key")).alias("mask"))
    possible = keys.join(sized(bloom), (F.col("at") == F.col("block")) & (F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))).select("url", "key")
    hits = possible.join(sized(listed), F.col("key") == F.col("listed"))
    best = hits.groupBy("url").agg(F.min_by(F.struct("key", "verdict"), F.struct(-F.char_length("key"), F.col("key"), F.col("verdict"))).alias("best")).select(F.col("url").alias("judged"), "best.*")
    rows = pages.select("page_id", "url").join(best, F.col("url") == F.col("judged"), "left")
    return rows.select("page_id", host.alias("host"), path.alias("path"), F.col("key").alias("rule"), F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = f"""
WITH rules(h, p, v) AS (VALUES {_VALUES}),
rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages),
parts AS (SELECT r, page_id, translate(regexp_extract(s, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hits AS (SELECT r, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC, h || p, v) AS k FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (r)
"""
