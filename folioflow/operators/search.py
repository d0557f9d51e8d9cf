"""Search and replacement over items, documents and overlay texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Most matches a page, and a document, that a search reports: they are the feature.
PAGE_CAP, DOC_CAP = 5000, 1000


def pattern_of(query: str, *, case: bool = False, regex: bool = False, whole_word: bool = False) -> str:
    """A Java pattern for a query."""
    body = query if regex else "".join("\\" + c if c in r"\.^$|?*+()[]{}" else c for c in query)
    body = rf"\b(?:{body})\b" if whole_word else body
    return body if case else f"(?i){body}"


def safe_pattern(query: str) -> bool:
    """Refuses patterns that can take very long: over 200 characters, nested quantifiers, repeated alternations."""
    return len(query) <= 200 and not re.search(r"\([^()]*[+*][^()]*\)[+*{]", query) and not re.search(r"\([^()]*\|[^()]*\)[+*{]", query)


def arabic_query(query: str) -> bool:
    """Whether a query has a letter of Arabic script."""
    return bool(re.search("[؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿]", query))


def match_offsets(text: Column, pattern: str) -> Column:
    """Array of <start, found> of the matches that are not empty, in order (starts from 0).

    The pieces between matches give the offsets, so the text is scanned twice and nothing is expanded.
    """
    found = F.filter(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: m != "")
    pieces = F.split(text, pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,found:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.char_length(x["p"])
        return F.struct((start + F.char_length(x["m"])).alias("at"), F.concat(s["out"], F.array(F.struct(start.alias("start"), x["m"].alias("found")))).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("p"), found.alias("m")), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, zero, step, lambda s: s["out"])


def search_items(items: DataFrame, query: str, *, case: bool = False, regex: bool = False) -> DataFrame:
    """doc_id, page, seq, start, found, mx, my, mw, mh: every match inside an item with its box by mean character width, at most ``PAGE_CAP`` a page in item order."""
    if not query.strip():
        return items.select("doc_id", "page", "seq", F.lit(0).alias("start"), F.col("str").alias("found"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("w").alias("mw"), F.col("size").alias("mh")).where("false")
    p = pattern_of(query, case=case, regex=regex)
    hits = items.where(F.col("str").rlike(p)).select("*", F.explode(match_offsets(F.col("str"), p)).alias("m"))
    each = F.col("w") / F.greatest(F.lit(1), F.char_length("str"))
    boxed = hits.select("doc_id", "page", "seq", F.col("m.start").alias("start"), F.col("m.found").alias("found"), (F.col("x") + F.col("m.start") * each).alias("mx"), F.col("y").alias("my"), (F.greatest(F.lit(1), F.char_length("m.found")) * each).alias("mw"), F.col("size").alias("mh"))
    k = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("seq", "start"))
    return boxed.withColumn("k", k).where(F.col("k") <= PAGE_CAP).drop("k")


@F.pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Compatibility normal form, which Spark has no function for."""
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def search_normalized(items: DataFrame, query: str, *, case: bool = False) -> DataFrame:
    """doc_id, page, seq: items with no raw match whose compatibility form holds the query (in either order of characters); only items beyond ASCII go through Python."""
    p = pattern_of(query, case=case)
    if arabic_query(query):
        return items.select("doc_id", "page", "seq").where("false")
    odd = items.where(~F.col("str").rlike(p) & F.col("str").rlike(r"[^\x00-\x7F]")).withColumn("plain", compatible("str"))
    return odd.where(F.col("plain").rlike(p) | F.reverse("plain").rlike(p)).select("doc_id", "page", "seq")


def find(docs: DataFrame, query: str, *, case: bool = False, regex: bool = False, whole_word: bool = False) -> DataFrame:
    """doc_id, block, start, found, truncated: matches in each line of a text, the first ``DOC_CAP`` a document; the flag says that the cap was reached."""
    p = pattern_of(query, case=case, regex=regex, whole_word=whole_word)
    blocks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line")).where(F.col("line").rlike(p))
    hits = blocks.select("doc_id", "block", F.explode(match_offsets(F.col("line"), p)).alias("m")).select("doc_id", "block", "m.start", "m.found")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("block", "start"))
    first = hits.withColumn("k", k).where(F.col("k") <= DOC_CAP)
    return first.withColumn("truncated", F.max("k").over(Window.partitionBy("doc_id")) >= DOC_CAP).drop("k")


def replacement(template: str, regex: bool) -> str:
    """A Java replacement: ``$n`` stands for a group in regex mode, and for itself otherwise."""
    return template if regex else template.replace("\\", "\\\\").replace("$", "\\$")


def replace_all(docs: DataFrame, query: str, template: str, *, col: str = "text", case: bool = False, regex: bool = False, whole_word: bool = False) -> DataFrame:
    """doc_id, replaced: texts that change, after replacement."""
    p = pattern_of(query, case=case, regex=regex, whole_word=whole_word)
    out = docs.select("doc_id", F.col(col).alias("before"), F.regexp_replace(F.col(col), F.lit(p), F.lit(replacement(template, regex))).alias("replaced"))
    return out.where("before <> replaced").select("doc_id", "replaced")


def replace_overlay(elements: DataFrame, query: str, template: str, *, case: bool = False, regex: bool = False) -> DataFrame:
    """element_id, text of the elements that change; unsafe or invalid patterns change nothing."""
    try:
        re.compile(query if regex else re.escape(query))
    except re.error:
        return elements.select("element_id", "text").where("false")
    if not query or (regex and not safe_pattern(query)):
        return elements.select("element_id", "text").where("false")
    new = F.regexp_replace("text", F.lit(pattern_of(query, case=case, regex=regex)), F.lit(replacement(template, regex)))
    return elements.select("element_id", "text", new.alias("new")).where("text <> new").select("element_id", F.col("new").alias("text"))


def list_matches(source: DataFrame, overlay: DataFrame) -> DataFrame:
    """Source matches in page order, then overlay matches in page order (kind, doc_id, page, seq, start), as a position for sorting."""
    both = source.select(F.lit(0).alias("kind"), "doc_id", "page", "seq", "start", "found").unionByName(overlay.select(F.lit(1).alias("kind"), "doc_id", "page", "seq", "start", "found"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("kind", "page", "seq", "start")))


def recent_distinct(df: DataFrame, keys: list[str], value: str, ts: str, *, n: int = 8) -> DataFrame:
    """keys, value, rank: the ``n`` values used last, alike whatever their case; the latest spelling."""
    latest = df.groupBy(*keys, F.lower(value).alias("low")).agg(F.max(ts).alias("ts"), F.max_by(value, ts).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ts"), "low"))
    return latest.withColumn("rank", rank).where(F.col("rank") <= n).select(*keys, "value", "rank")


def last_n(df: DataFrame, keys: list[str], ts: str, tie: str, *, n: int = 200, detail: str | None = None, cut: int = 600) -> DataFrame:
    """The newest ``n`` rows of each key with their place, oldest first; long details are cut as the ring does."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc(ts), F.desc(tie)))
    kept = df.withColumn("k", rank).where(F.col("k") <= n)
    out = kept.withColumn("place", F.max("k").over(w) - F.col("k") + 1).drop("k")
    return out.withColumn(detail, F.substring(detail, 1, cut)) if detail else out
