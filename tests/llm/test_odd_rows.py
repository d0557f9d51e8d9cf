"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and pipeline stage."""

import datetime

import public_tokenizers
import pytest

import corpus_pipeline
from folioflow.llm import bpe_codec, decontamination, language_id, line_dedup, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, url_filter

#: Columns with names that operators use for themselves.
CLASHING = ["__key", "key", "block", "tag", "score", "lang_pred", "hash", "of", "node", "n", "bad_id", "text_", "w"]
LONG = "the long text has many words and lines\n" * 3000


@pytest.fixture
def odd(spark):
    texts = [(None, None, "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "de"), (4, LONG, "en"), (5, "x" * 5000, "fr"), (6, "the cat sat\non the mat\nand slept", "en"), (6, "the cat sat\non the mat\nand slept", "en"), (7, "the cat sat\non the mat\nand slept", None), (8, "123 !? 漢字 é", "fr"), (None, "the dog ran far away from here", "en")]
    rows = [(d, t, lang, "s", len(t or ""), *range(len(CLASHING) - 1), datetime.date(2020, 1, 1)) for d, t, lang in texts]
    columns = ", ".join(f"`{c}` int" for c in CLASHING[:-1]) + f", `{CLASHING[-1]}` date"
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {columns}").repartition(2)


def library(spark):
    return {
        "op1": lambda d: suffix_dedup.remove_repeated_bytes(d),
        "op2": lambda d: bpe_codec.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")),
        "op3": lambda d: language_id.predict_languages(d),
        "op4": lambda d: line_dedup.repeated_chunks(d),
        "op5": lambda d: simhash_dedup.near_duplicates(d),
        "op7": lambda d: token_counts.count_tokens(d, public_tokenizers.path("byte_bpe_50k.json")),
        "op9": lambda d: substring_dedup.remove_repeats(d),
        "op10": lambda d: quality_rules.judge_quality(d, spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")),
    }


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op5", "op7", "op9", "op10"])
def test_operators_return_a_row_for_each(spark, odd, name):
    run = library(spark)[name]
    rows = run(odd).collect()
    key = lambda v: (v is not None, v or 0)
    assert sorted((r.doc_id for r in rows), key=key) == sorted((r.doc_id for r in odd.collect()), key=key)
    same = [tuple(r) for r in rows if r.doc_id == 6]
    assert len(same) == 2 and same[0] == same[1]
    assert run(odd.limit(0)).count() == 0


def test_pairs_and_urls_of_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, LONG[:200]), (2, None), (3, ""), (None, "the dog ran far away from here")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contained_items(odd, bench).collect()}
    assert got == {(4, 1), (None, None)}
    pages = odd.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "url")
    assert url_filter.judge_urls(pages, url_filter.rule_table(spark)).where("verdict = 'allow' AND host = ''").count() == 11


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "bpe_encoding"], ids=lambda s: s[0])
def test_stages_leave_other_columns_alone(spark, small, odd, stage):
    kept = stage[1](spark, odd, small)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    rows = kept.collect()
    assert rows and all(tuple(r[c] for c in CLASHING) == (*range(len(CLASHING) - 1), datetime.date(2020, 1, 1)) for r in rows)
    assert stage[1](spark, odd.limit(0), small).count() == 0
    ids = [r.doc_id for r in rows]
    if stage[0] == "language_id":
        assert set(ids) == {None, 4, 5, 6, 7, 8} and ids.count(6) == 2
    if stage[0] == "line_dedup":
        assert {1, 2, 3, 4, 5, 6, 8} <= set(ids) and 7 not in ids and ids.count(6) == 2
    if stage[0] == "near_dedup":
        # null, empty and blank texts are one group; so are equal ones
        assert sorted((i is not None, i or 0) for i in ids) == [(False, 0), (False, 0), (True, 4), (True, 5), (True, 6), (True, 8)]
