"""Operator 10: quality rules whose thresholds are risk-controlled on labelled documents.

Every rule rejects a document whose share (symbols per character, repeated lines per line, repeated
words per word) is over a cutoff. Cutoffs come from a fixed grid and are tested on the documents that
carry a quality label: for a stratum (language), a cutoff is safe when the exact binomial tail
P(Bin(n, alpha) <= k) of its k rejected among n good documents is at most delta divided by the number
of tests (Bonferroni). The lowest safe cutoff of each rule and stratum applies; a rule with none does
not reject there. With probability 1 - delta every chosen cutoff rejects at most alpha of good documents.

Only DataFrame functions are used. Defined results: a null text has no words and fails the base rule;
a null language is a stratum of its own; a document whose label is missing or null does not take part
in the tests; of several labels for one id the lowest holds; repeated rows are judged each; an empty
labels table leaves only the base rule; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, checkpointed, words

SYMBOLS = "#*$%&|<>"
#: Cutoffs that are tested, in thousandths.
GRID = (5, 10, 20, 50, 100, 200, 300, 400, 500)
#: name: (numerator, denominator)
RULES = {"symbols": ("n_symbols", "word_chars"), "lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
#: Most false rejections of a rule in a stratum, and the probability that any chosen cutoff breaks it.
ALPHA, DELTA = 0.02, 0.05
#: Strata up to which the chosen cutoffs are broadcast.
BROADCAST_STRATA = 10_000


def repeated_words(order: Column) -> Column:
    """Words inside three-word windows that occur twice or more; ``order`` is a column of the windows' <hash h, place i>, sorted."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    marked = F.transform(order, lambda x, j: F.when(same(F.get(order, j - 1), x) | same(F.get(order, j + 1), x), x["i"]))
    return F.aggregate(
        F.sort_array(F.filter(marked, lambda i: i.isNotNull())),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id, stratum and the counts of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda c: F.translate(c, BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: bare(x) != "")
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null")).alias("stratum"), words(F.col("text")).alias("w"), lines.alias("lines"), F.char_length(bare(text)).cast("long").alias("word_chars"), (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    three = F.when(F.size("w") >= 3, F.transform(F.slice("w", 1, F.size("w") - 2), lambda x, i: F.xxhash64(x, F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc_id", "stratum", "word_chars", "n_symbols", "w", F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), three.alias("three"))
    kept = ["doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    sorted_places = F.sort_array(F.transform("three", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    nothing = F.array().cast("array<struct<h:bigint,i:int>>")
    # each step is a projection of its own: what a lambda function names must be a column, or it is computed for every element
    rows = rows.select(*kept, F.when(F.size("three") > F.size(F.array_distinct("three")), sorted_places).otherwise(nothing).alias("order"))
    return rows.select(*kept, repeated_words(F.col("order")).cast("long").alias("n_repeat_words"))


def over(rule: str, cutoff: Column) -> Column:
    top, bottom = RULES[rule]
    return 1000 * F.col(top) > cutoff * F.col(bottom)


def binomial_tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k), summed term by term from logarithms."""
    odds, first = F.log(F.lit(alpha / (1 - alpha))), n * F.log(F.lit(1 - alpha))
    return F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.cast("double").alias("log"), F.exp(first).alias("sum")),
        lambda s, i: F.struct((s["log"] + F.log((n - i + 1) / i) + odds).alias("log"), (s["sum"] + F.exp(s["log"] + F.log((n - i + 1) / i) + odds)).alias("sum")),
        lambda s: s["sum"],
    )


def safe_cutoffs(features: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, int]:
    """stratum and, for each rule, cut_<rule>: the lowest cutoff that passes its test, or null. Also the number of strata."""
    good = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select(F.col("doc_id").alias("labelled_id"))
    held = features.join(good, features["doc_id"] == good["labelled_id"])
    hits = [F.count_if(over(r, F.lit(c))).alias(f"{r}_{c}") for r in RULES for c in GRID]
    counts = checkpointed(held.groupBy("stratum").agg(F.count("*").alias("n"), *hits))
    strata = counts.count()
    tests = max(1, strata * len(RULES) * len(GRID))
    passed = lambda r, c: (F.col(f"{r}_{c}") <= alpha * F.col("n")) & (binomial_tail(F.col("n"), F.col(f"{r}_{c}"), alpha) <= delta / tests)
    lowest = [F.coalesce(*[F.when(passed(r, c), F.lit(c)) for c in GRID]).alias(f"cut_{r}") for r in RULES]
    return counts.select(F.col("stratum").alias("cut_stratum"), *lowest), strata


def judge_quality(docs: DataFrame, labels: DataFrame, *, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the cutoffs that applied, for each row."""
    features = checkpointed(document_features(docs))
    cutoffs, strata = safe_cutoffs(features, labels, alpha=alpha, delta=delta)
    if strata <= BROADCAST_STRATA:
        cutoffs = F.broadcast(cutoffs)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(over(r, F.col(f"cut_{r}")), F.lit(False))
    judged = features.join(cutoffs, F.col("stratum") == F.col("cut_stratum"), "left").withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), *[f"cut_{r}" for r in RULES])


_SQL_LOWEST = ", ".join(f"min(c) FILTER (WHERE safe AND rule = '{r}') AS cut_{r}" for r in RULES)
_SQL_RULES = " UNION ALL ".join(f"SELECT f.stratum, '{r}' AS rule, g.c, count(*) AS n, count(*) FILTER (WHERE 1000 * {a} > g.c * {b}) AS k FROM held f, grid g GROUP BY ALL" for r, (a, b) in RULES.items())
_SQL_REJECT = " OR ".join(f"coalesce(1000 * {a} > cut_{r} * {b}, false)" for r, (a, b) in RULES.items())
ORACLE = f"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS stratum, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
starts AS (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM split),
dup AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS n FROM starts),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY r),
features AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM split LEFT JOIN covered USING (r)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM features WHERE doc_id IN (SELECT doc_id FROM good)),
grid AS (SELECT unnest({list(GRID)}) AS c),
counts AS ({_SQL_RULES}),
tested AS (SELECT *, k <= {ALPHA} * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) <= {DELTA} / (SELECT count(*) FROM counts) AS safe FROM counts),
cuts AS (SELECT stratum, {_SQL_LOWEST} FROM tested GROUP BY stratum),
judged AS (SELECT features.*, cut_symbols, cut_lines, cut_repeats, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features LEFT JOIN cuts USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_SQL_REJECT}) AS kept, cut_symbols, cut_lines, cut_repeats FROM judged
"""
