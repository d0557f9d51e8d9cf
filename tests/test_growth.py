"""What has to stay in proportion to the texts: nothing of the items is written or shuffled, and no fold looks at all lines for each item."""

import re

import pytest

from folioflow.functions import bidi, lineage
from folioflow.plans import registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    """The keys by which rows are shuffled."""
    return re.findall(r"Exchange (\w+\(?[^\n]*?), [A-Z_]+", plan_of(df))


def watch(monkeypatch):
    """Collects the tables that operators and plans write to the checkpoint folder."""
    saved = []
    for module in ("operators.layout", "operators.tables", "operators.reconcile", "plans.pipelines"):
        monkeypatch.setattr(f"folioflow.{module}.written", lambda df: saved.append(df) or lineage.written(df), raising=False)
    return saved


@pytest.mark.parametrize("name", ["w9_cluster_lines"])
def test_folds_of_lines_cut_rows_out(spark, small, name):
    """A line's rows are a slice; the starts of all lines are not filtered for each item."""
    plan = plan_of(registry.QUERIES[name](spark, small))
    assert "slice(" in plan and "filter(" not in plan


@pytest.mark.parametrize("name", ["w6_column_cut", "w7_split_columns", "w8_split_slabs", "w5_borderless_tables", "a10_spanning_ratio", "e2_table_csv"])
def test_items_are_neither_written_nor_shuffled(spark, small, name, monkeypatch):
    """Only the texts are dealt, before there are items."""
    saved = watch(monkeypatch)
    got = exchanges(registry.QUERIES[name](spark, small))
    assert not saved and got and all(re.fullmatch(r"hashpartitioning\(doc_id#\d+L, \d+\)", e) for e in got)


def test_markdown_writes_paragraphs_only(spark, small, monkeypatch):
    """Neither items nor cells are written on the way to Markdown."""
    saved = watch(monkeypatch)
    registry.QUERIES["e1_markdown_corpus"](spark, small)
    assert saved and all("para" in df.columns and "seq" not in df.columns for df in saved)


def test_clips_are_carried_without_writing(spark, small, monkeypatch):
    """The marked stream is not written, and both extractions keep their dealing where they are compared."""
    saved = watch(monkeypatch)
    assert registry.QUERIES["j20_carry_clips"](spark, small) is not None and not saved
    got = exchanges(registry.QUERIES["j20_align_items"](spark, small))
    assert got and all(re.fullmatch(r"hashpartitioning\(doc_id#\d+L, \d+\)", e) for e in got)


@pytest.mark.parametrize("name", ["w15_order_line", "w17_logical_lines"])
def test_words_keep_their_dealing_through_python(spark, small, name):
    """Lines are gathered before Python normalises their words, so that no word is shuffled after it."""
    got = exchanges(registry.QUERIES[name](spark, small))
    assert got and all(re.fullmatch(r"hashpartitioning\(doc_id#\d+L, \d+\)", e) for e in got)


def test_words_are_turned_once():
    """Words repeat: each is turned once a worker, in a store of bounded size."""
    bidi.logical.cache_clear()
    assert [bidi.logical("مالس") for _ in range(3)] == ["سلام"] * 3
    assert bidi.logical.cache_info().hits == 2 and bidi.logical.cache_info().maxsize


def test_written_rows_leave_no_shuffles(spark):
    """A round's shuffles are removed once its rows are written, so that a closure never holds those of all rounds."""
    import time

    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("/shuffle_")
    before = held()
    rows = lineage.written(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count())
    deadline = time.time() + 20
    while held() > before and time.time() < deadline:
        time.sleep(0.1)
    assert held() <= before and rows.count() == 7


@pytest.mark.parametrize("name", ["x3_search_lines", "w17_logical_lines"])
def test_lines_are_made_once_inside_of_their_rows(spark, small, name):
    """Words are made from the texts once, gathered once, and neither joined again nor put in windows."""
    plan = plan_of(registry.QUERIES[name](spark, small))
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan and "Window" not in plan


def test_search_finds_words_in_the_row_of_their_line(spark):
    """A match over two words of a line that is read from the right, one of a bracket, and none on an empty line."""
    words = [(1, 0, 0, "سلام", 100.0, 700.0, 20.0, 10.0), (1, 0, 1, "لام", 60.0, 700.0, 20.0, 10.0), (1, 0, 2, "ab", 10.0, 650.0, 20.0, 10.0), (1, 0, 3, "cd", 40.0, 650.0, 20.0, 12.0), (1, 0, 4, "", 70.0, 650.0, 20.0, 12.0)]
    items = spark.createDataFrame(words, "doc_id long, page int, seq long, str string, x double, y double, w double, size double")
    from folioflow.operators import tagged

    found = lambda q, **kw: [tuple(r)[2:] for r in tagged.search_lines(items, q, **kw).collect()]
    assert found("م ل") == found("م ل", rtl=True) == [(0, 3, "م ل", 60.0, 120.0, 700.0, 710.0)]
    assert found("B C") == [(1, 1, "b c", 10.0, 60.0, 650.0, 662.0)] and found("B C", rtl=True) == []
