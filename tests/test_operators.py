"""Edges, refusals and invariants on tables of our own."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.functions import geometry, text
from folioflow.functions.fonts import normalize_fonts
from folioflow.functions.bidi import logical
from folioflow.operators import document, html, layout, manifest, reconcile, redact, search, tables, tagged
from folioflow.sources import ocr
from folioflow.streaming import jobs

ITEM = "doc_id long, page int, seq long, str string, x double, y double, w double, size double, a double, b double"


def items(spark, rows):
    return spark.createDataFrame([(1, 0, i, s, x, y, w, z, z, 0.0) for i, (s, x, y, w, z) in enumerate(rows)], ITEM)


def pages(spark):
    return spark.createDataFrame([(1, 0, 612.0, 792.0)], "doc_id long, page int, page_width double, page_height double")


def red(spark, x, y_down, w, h):
    return spark.createDataFrame([(1, 0, x, y_down, w, h)], "doc_id long, page int, rx double, ry_down double, rw double, rh double")


def test_redaction_is_strict_and_reaches_under_the_baseline(spark):
    it = items(spark, [("touching", 0.0, 100.0, 50.0, 10.0), ("inside", 60.0, 100.0, 20.0, 10.0), ("below", 60.0, 120.0, 20.0, 12.0)])
    # y from 90 to 118 upwards: the third item's descender reaches down to 117
    kept = redact.redact_items(it, red(spark, 50.0, 674.0, 100.0, 28.0), pages(spark))
    assert {r.str for r in kept.collect()} == {"touching"}


def test_unreadable_annotations_go_only_where_something_is_redacted(spark):
    rows = [(1, 0, "null", None), (1, 0, "nan", [0.0, float("nan"), 5.0, 5.0]), (1, 0, "reversed", [90.0, 120.0, 60.0, 100.0]), (1, 0, "far", [400.0, 400.0, 420.0, 420.0]), (2, 0, "other page", None)]
    annots = spark.createDataFrame(rows, "doc_id long, page int, name string, rect array<double>")
    kept = redact.redact_annots(annots, red(spark, 50.0, 674.0, 100.0, 28.0), pages(spark))
    assert {r.name for r in kept.collect()} == {"far", "other page"}


def test_clusters_follow_the_previous_value(spark):
    df = spark.createDataFrame([(1, v) for v in (0.0, 3.0, 6.0, 9.5, 20.0)], "k int, v double")
    got = sorted((r.cluster, r.center) for r in layout.cluster_positions(df, ["k"], "v").collect())
    assert got == [(0, 3.0), (1, 9.5), (2, 20.0)]


def test_baselines_are_held_against_the_head_of_the_line(spark):
    it = items(spark, [("a", 0.0, 100.0, 5.0, 10.0), ("b", 10.0, 98.0, 5.0, 10.0), ("c", 20.0, 96.0, 5.0, 10.0)])
    assert sorted((r.seq, r.line) for r in layout.cluster_baselines(it).collect()) == [(0, 0), (1, 0), (2, 1)]


def test_lines_take_superscripts_in(spark):
    it = items(spark, [("base", 0.0, 100.0, 30.0, 12.0), ("2", 31.0, 106.0, 4.0, 6.0), ("next", 0.0, 80.0, 30.0, 12.0)])
    lines = {r.seq: r.line for r in layout.cluster_lines(it).collect()}
    assert lines[0] == lines[1] != lines[2]


def test_cells_are_half_open_but_for_the_outer_edges(spark):
    it = items(spark, [("tl", 0.0, 20.0, 1.0, 10.0), ("mid", 10.0, 10.0, 1.0, 10.0), ("right", 20.0, 5.0, 1.0, 10.0), ("out", 21.0, 5.0, 1.0, 10.0)])
    bounds = spark.createDataFrame([(1, 0, [0.0, 10.0, 20.0], [0.0, 10.0, 20.0])], "doc_id long, page int, xs array<double>, ys array<double>")
    got = {(r.r, r.c): r.text for r in tables.assign_cells(it, bounds).collect()}
    assert got == {(0, 0): "tl", (0, 1): "mid", (1, 1): "right"}


def test_borderless_needs_three_lines_and_short_cells(spark):
    grid = [(f"c{r}{c}", c * 100.0, 700.0 - r * 14, 20.0, 12.0) for r in range(4) for c in range(3)]
    assert tables.borderless_tables(items(spark, grid)).count() == 12
    assert tables.borderless_tables(items(spark, grid[:6])).count() == 0
    prose = [(f"{s} several words in one cell", x, y, w, z) for s, x, y, w, z in grid]
    assert tables.borderless_tables(items(spark, prose)).count() == 0


def test_list_prefixes(spark):
    want = {
        "• one": "bullet", "- two": "bullet", "→ x": "bullet", "► x": "bullet", "▸ x": "bullet", "○ x": "bullet", "– x": None, "* three": None, "•x": None, " • x": None,
        "1. x": "decimal", "1) x": "decimal", "(12) x": "decimal", "(1. x": None, "(1 x": None, "1.x": None,
        "(iv) x": "roman", "iv) x": "roman", "(III) x": "upper_roman", "XIV) x": "upper_roman", "iiii) x": None, "(xyz) x": None, "iv. x": None,
        "(a) x": "lower", "a) x": "lower", "(i) x": "lower", "B) x": "upper", "(I) x": "upper", "a. x": None, "A. Smith": None, "plain": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string").select("t", text.list_prefix(F.col("t")).alias("p"))
    got = {r.t: r.p for r in df.collect()}
    assert {t: p and p.kind for t, p in got.items()} == want
    assert got["(III) x"][1:] == ("III", "(%1)", "x") and got["1) x"].form == "%1)" and got["1. x"].form == "%1."
    assert got["→ x"].rest == "x"


def test_upper_roman_lists_stay_upper(spark):
    paras = spark.createDataFrame([(1, k, f"{m}) x") for k, m in enumerate(["II", "III", "IV"])], "doc_id long, ord long, text string")
    got = document.list_ordinals(paras).withColumn("m", document.list_marker(F.col("kind"), F.col("ordinal"))).orderBy("ord").collect()
    assert [r.m for r in got] == ["I. ", "II. ", "III. "]


LINES = "doc_id long, page int, line int, y double, size double, text string, x0 double, x1 double, split boolean"


def paragraphs_of(spark, rows, width=600.0):
    """rows of <y, size, text, x1, split>."""
    lines = spark.createDataFrame([(1, 0, k, float(y), float(size), t, 50.0, float(x1), split) for k, (y, size, t, x1, split) in enumerate(rows)], LINES)
    pages = None if width is None else spark.createDataFrame([(1, 0, width)], "doc_id long, page int, page_width double")
    return [r.para for r in layout.group_paragraphs(lines, pages).orderBy("line").collect()]


def test_lines_far_apart_are_paragraphs_of_their_own(spark):
    assert paragraphs_of(spark, [(700 - 39 * k, 10, "x", 500, False) for k in range(5)]) == [0, 1, 2, 3, 4]


def test_wide_leading(spark):
    wide = [(700 - 16.1 * k, 10, "x", 500, False) for k in range(5)]
    assert paragraphs_of(spark, wide) == [0, 0, 0, 0, 0]
    # not without the page's width, nor where the widest line is a small part of the page
    assert paragraphs_of(spark, wide, None) == [0, 1, 2, 3, 4]
    assert paragraphs_of(spark, wide, 2000.0) == [0, 1, 2, 3, 4]
    # rows of a table, short lines above, marks
    assert paragraphs_of(spark, [(y, s, t, x, True) for y, s, t, x, _ in wide]) == [0, 1, 2, 3, 4]
    assert paragraphs_of(spark, [(y, s, t, 200 if k == 1 else x, p) for k, (y, s, t, x, p) in enumerate(wide)]) == [0, 0, 1, 1, 1]
    assert paragraphs_of(spark, [(y, s, "• x" if k == 3 else t, x, p) for k, (y, s, t, x, p) in enumerate(wide)]) == [0, 0, 0, 1, 1]
    # two equal gaps are needed; 18 sizes is too far
    assert paragraphs_of(spark, wide[:2]) == [0, 1]
    assert paragraphs_of(spark, [(700 - 18 * k, 10, "x", 500, False) for k in range(4)]) == [0, 1, 2, 3]


def test_usual_gaps(spark):
    # 16.2 is beyond 1.6 sizes and within a tenth of 15, unless the line is marked; the mark of a close line changes nothing
    rows = [(700, 10), (685, 10), (670, 10), (653.8, 10), (637.6, 10), (622.6, 10)]
    assert paragraphs_of(spark, [(y, s, "x", 300, False) for y, s in rows]) == [0] * 6
    assert paragraphs_of(spark, [(y, s, "- x" if k in (1, 4) else "x", 300, False) for k, (y, s) in enumerate(rows)]) == [0, 0, 0, 0, 1, 1]
    # a jump in size parts; gaps over 1.6 sizes are no samples
    assert paragraphs_of(spark, [(700, 10, "x", 300, False), (688, 11, "x", 300, False), (676, 11, "x", 300, False)]) == [0, 1, 1]
    assert paragraphs_of(spark, [(700, 10, "x", 300, False), (683, 10, "x", 300, False), (666, 10, "x", 300, False)], None) == [0, 1, 2]


def ordered(spark, words, base=None):
    rows = [(1, 0, k, 10.0 * k, w) for k, w in enumerate(words)]
    df = tagged.order_line(spark.createDataFrame(rows, "doc_id long, line int, seq long, x double, str string"), ["doc_id", "line"], base=base)
    return [r.read for r in df.orderBy("pos").collect()]


SALAM, LONG = "سلام", "المستندات"


def test_base_goes_by_letters(spark):
    # nine letters against two: right to left, the Latin run forward and first to be read last
    assert ordered(spark, [LONG, "a", "b"]) == ["a", "b", LONG]
    assert ordered(spark, ["a", "b", LONG]) == [LONG, "a", "b"]
    assert ordered(spark, ["words", "more", SALAM]) == ["words", "more", SALAM]
    assert ordered(spark, ["1", "2"]) == ["1", "2"] and ordered(spark, ["1", "2"], F.lit(True)) == ["2", "1"]


def test_words_without_letters(spark):
    # between two directions the base decides: eight letters to four make it right to left, four to five left to right
    assert ordered(spark, ["word", "--", SALAM, SALAM]) == [SALAM, SALAM, "--", "word"]
    assert ordered(spark, ["words", "--", SALAM]) == ["words", "--", SALAM]
    # a number that touches a Latin word belongs to it; one among Arabic words does not
    assert ordered(spark, [LONG, "v", "2.0"]) == ["v", "2.0", LONG]
    assert ordered(spark, [SALAM, "20", LONG]) == [LONG, "20", SALAM]


def test_brackets_of_both_producers(spark):
    # drawn from left to right: the shapes of one producer, the logical characters of the other
    assert ordered(spark, [SALAM, "(", "RTL", ")", LONG]) == [LONG, "(", "RTL", ")", SALAM]
    assert ordered(spark, [SALAM, ")", "RTL", "(", LONG]) == [LONG, "(", "RTL", ")", SALAM]
    # what does not balance when mirrored either stays, as do brackets of Latin lines
    assert ordered(spark, [SALAM, "(", LONG]) == [LONG, "(", SALAM]
    assert ordered(spark, ["a", ")", "b", "("]) == ["a", ")", "b", "("]
    assert ordered(spark, [SALAM, "]", "x", "[", "(", "y", ")", LONG])[0] == LONG


def test_roman_and_letters(spark):
    r = spark.range(1).select(text.roman(F.lit(1994)).alias("r"), text.letters_of(F.lit(28)).alias("l")).first()
    assert (r.r, r.l) == ("mcmxciv", "ab")


def test_links(spark):
    rows = [" http://a.b ", "a.b/c", "ftp://x.y", "word", "java\x01script:x", "MAILTO:x@y.z"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, u string").orderBy("i")
    got = df.select(text.clean_link(F.col("u")).alias("c"), text.allowed_scheme(F.col("u")).alias("a")).collect()
    assert [r.c for r in got] == ["http://a.b", "https://a.b/c", None, None, None, "MAILTO:x@y.z"] or [r.c for r in got][4] is None
    assert [r.a for r in got] == [True, True, False, True, False, True]


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_reprojection_round_trip(spark, turn):
    w, h = F.lit(600.0), F.lit(800.0)
    cx, cy = geometry.to_content_point(F.lit(30.0), F.lit(50.0), w, h, F.lit(turn))
    x, y = geometry.to_display_point(cx, cy, w, h, F.lit(turn))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r.x, r.y) == (30.0, 50.0)


def test_running_bands_need_three_pages(spark):
    rows = [(1, p, p * 3 + k, t, y, 10.0, 800.0) for p in range(3) for k, (t, y) in enumerate([(f"Report  {p}", 770.0), (f"body {p}x", 400.0), (f"{p}", 40.0)])]
    paras = spark.createDataFrame(rows, "doc_id long, page int, ord long, text string, y double, size double, page_height double")
    bands = document.running_bands(paras).collect()
    assert [(b.band, b.key, b.text) for b in bands] == [("header", "report", "Report  0")]
    assert document.running_bands(paras.where("page < 2")).count() == 0
    assert document.drop_bands(paras, document.running_bands(paras)).count() == 6


def test_reorder_is_a_permutation_or_nothing(spark):
    m = spark.createDataFrame([(s, s * 10 + i, i) for s in (1, 2) for i in (1, 2, 3)], "source_id long, page_id long, position long")
    order = spark.createDataFrame([(1, 13, 0), (1, 11, 1), (1, 12, 2), (1, 99, 3), (2, 21, 0), (2, 21, 1), (2, 22, 2)], "source_id long, page_id long, at long")
    got = sorted((r.source_id, r.position, r.page_id) for r in manifest.reorder_pages(m, order).collect())
    assert [g[2] for g in got] == [13, 11, 12, 21, 22, 23]


def test_stamps_have_no_gap_whatever_the_partitions(spark):
    pages_df = spark.range(1000).selectExpr("id * 7 % 1000 AS page_id").repartition(7)
    got = sorted((r.n, r.page_id, r.stamp) for r in manifest.stamp_pages(pages_df, prefix="A", start=99999, digits=5).collect())
    assert [g[0] for g in got] == list(range(1, 1001)) and [g[1] for g in got] == list(range(1000))
    assert got[0][2] == "A99999" and got[1][2] == "A100000"


def test_page_specs(spark):
    m = spark.createDataFrame([(1, i, i) for i in range(1, 8)], "source_id long, page_id long, position long")
    pick = lambda s: sorted(r.position for r in manifest.select_pages(m, s).collect())
    assert pick("1-3, 5") == [1, 2, 3, 5] and pick("9-6,x,0,2-") == [6, 7] and pick("1-999999999") == list(range(1, 8))


def test_closure_with_cycles_and_dangling(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("x", "y")], "src string, dst string")
    nodes = spark.createDataFrame([(n, True) for n in "abxy"], "node string, readable boolean")
    roots = spark.createDataFrame([("a",)], "node string")
    assert {r.node for r in reconcile.unreachable(nodes.select("node"), edges, roots).collect()} == {"x", "y"}
    drops = spark.createDataFrame([("b", 1, "drop"), ("a", 1, "drop"), ("a", 2, "assign"), ("x", 1, "drop")], "node string, seq int, action string")
    got = {(r.node, r.kind) for r in reconcile.dangling_refs(nodes, edges, roots, drops).collect()}
    assert got == {("c", "dangling"), ("b", "dropped")}


def test_targets_of_relationships(spark):
    rows = {
        ("word/document.xml", "media/a.png"): "word/media/a.png", ("word/document.xml", "../media/./a.png"): "media/a.png", ("word/document.xml", "../../../a.png"): "a.png",
        ("word/document.xml", "/word/../a.png"): "word/../a.png", (None, "word//x/../document.xml"): "word/document.xml", ("top.xml", "a b"): "a b",
    }
    df = spark.createDataFrame(list(rows), "o string, t string").select("o", "t", reconcile.resolve_target(F.col("o"), F.col("t")).alias("p"))
    assert {(r.o, r.t): r.p for r in df.collect()} == rows
    keys = {"Word/Media/A.PNG": "word/media/a.png", "m/%E5%9B%B3+1.png": "m/図+1.png", "m/100%.png": "m/100%.png", "m/%FF.png": "m/%ff.png", "m/%2541": "m/%41"}
    df = spark.createDataFrame([(k,) for k in keys], "t string").select("t", reconcile.part_key(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == keys


def test_orphans_fail_safe(spark):
    parts = spark.createDataFrame([(p, f, ok) for p in (1, 2) for f, ok in [*((f"word/media/{x}.png", True) for x in "abcdefg"), ("word/doc.xml", True), ("word/bad.xml", False), ("word/_rels/doc.xml.rels", p == 1)]], "package int, path string, readable boolean")
    rels = [("word/doc.xml", "r1", "media/%41.PNG"), ("word/doc.xml", "r2", "media/b.png"), ("word/bad.xml", "r3", "../word/media/c.png"), (None, "r4", "word/media/d.png"), ("word/gone.xml", "r5", "media/e.png"), ("word/doc.xml", "r1", "/media/f.png")]
    rels = spark.createDataFrame([(1, *r) for r in rels], "package int, owner string, rel_id string, target string")
    attrs = spark.createDataFrame([(1, "word/doc.xml", "r1")], "package int, owner string, value string")
    named = spark.createDataFrame([(1, "/Word/media/g.png")], "package int, path string")
    got = sorted((r.package, r.path) for r in reconcile.orphan_parts(parts, rels, named, attrs).collect())
    assert got == [(1, "word/media/b.png"), (1, "word/media/f.png")]


def test_search_offsets_and_boxes(spark):
    it = items(spark, [("abcabc", 10.0, 5.0, 60.0, 10.0)])
    got = [(r.start, r.mx, r.mw) for r in search.search_items(it, "BC").orderBy("start").collect()]
    assert got == [(1, 20.0, 20.0), (4, 50.0, 20.0)]
    assert search.search_items(it, "  ").count() == 0


def test_normalised_search_only_on_misses(spark):
    it = items(spark, [("ﬁne ﬂow", 0.0, 0.0, 1.0, 10.0), ("fine", 0.0, 0.0, 1.0, 10.0)])
    assert [r.seq for r in search.search_normalized(it, "fine").collect()] == [0]


def test_replacement_templates(spark):
    el = spark.createDataFrame([(1, "a.b a$b"), (2, "none")], "element_id int, text string")
    assert [(r.element_id, r.text) for r in search.replace_overlay(el, "a$b", "$1").collect()] == [(1, "a.b $1")]
    assert search.replace_overlay(el, "(a+)+b", "x", regex=True).count() == 0
    assert search.replace_overlay(el, "(a", "x", regex=True).count() == 0


def test_fonts(spark):
    fonts = spark.createDataFrame([("ABCDEF+TimesNewRomanPS-BoldMT",), ("g_d0_f1",), ("ArialNarrow-Bold",)], "font string")
    mapping = spark.createDataFrame([("timesnewroman", "Times New Roman")], "key string, canonical string")
    got = {r.font: (r.name, r.bold) for r in normalize_fonts(fonts, mapping).collect()}
    assert got["ABCDEF+TimesNewRomanPS-BoldMT"] == ("Times New Roman", True) and got["ArialNarrow-Bold"][0] == "Arial Narrow" and got["g_d0_f1"][0] == "serif"


def test_html_tree_rules():
    got = html.cleaned('<p class="x" style="color:red;margin:0">a<o:p>b</o:p></p><script>bad()</script><p> </p><a href="java&#1;script:x">l</a><img src="data:text/html,x">')
    assert got == '<p style="color:red">ab</p><a>l</a>'
    assert html.cleaned(None) is None


def test_ocr_languages(spark):
    rows = [("ENG+fas+eng",), ("xyz",), (None,)]
    got = [r.n for r in spark.createDataFrame(rows, "c string").select(ocr.normalize_language(F.col("c")).alias("n")).collect()]
    assert got == ["eng+fas", "eng", "eng"]


def test_replay_log(spark):
    log = [(1, i, op, i) for i, op in enumerate(["undo", "execute", "execute", "undo", "redo", "undo", "execute", "redo"])]
    ev = spark.createDataFrame(log, "key int, seq int, op string, id long")
    assert jobs.replay(ev).first().commands == [1, 6]
    many = spark.createDataFrame([(1, i, "execute", i) for i in range(60)], "key int, seq int, op string, id long")
    assert jobs.replay(many).first().commands == list(range(10, 60))


PARTS = [
    # complete, one part twice
    (1, 0, 2, "a"), (1, 1, 2, "b"),
    # a repeat after the end starts a group that stays open
    (1, 1, 2, "b"),
    (2, 0, 2, "a"),
    # another text ends the group and is not kept: the second half alone is none, a new pair is
    (3, 0, 2, "a"), (3, 0, 2, "x"), (3, 1, 2, "b"), (3, 0, 2, "a"),
    # another total, then the whole group
    (4, 0, 2, "a"), (4, 1, 3, "b"), (4, 1, 2, "b"), (4, 0, 2, "a"), (4, 0, 2, "c"), (4, 1, 2, "d"),
    (5, 0, 1, None), (5, 0, 1, "z"),
]
WHOLE = [(1, 1, "ab"), (3, 1, "ab"), (4, 1, "ab"), (4, 2, "cd"), (5, 1, ""), (5, 2, "z")]
PART = "group_key long, seq long, idx long, total long, text string"


def test_assembly_begins_anew_after_conflicts(spark):
    parts = spark.createDataFrame([(g, n, *r) for n, (g, *r) in enumerate(PARTS)], PART)
    assert sorted(tuple(r) for r in jobs.assemble(parts.repartition(3)).collect()) == WHOLE
    assert jobs.assemble(parts.limit(0)).count() == 0


def test_empty_tables(spark):
    none = items(spark, []).limit(0)
    assert layout.line_texts(none, layout.cluster_baselines(none)).count() == 0
    assert tables.borderless_tables(none).count() == 0
    assert redact.redact_items(none, red(spark, 0.0, 0.0, 1.0, 1.0), pages(spark)).count() == 0


def test_typed_cells(spark):
    rows = ["1", "-1", "007", "+5", "1.", "1e3", "1.50", "0.125", "12345678901234567890", "x"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, text string")
    got = [r.num for r in tables.typed_cells(df).orderBy("i").collect()]
    assert got == [1.0, -1.0, None, None, None, None, 1.5, 0.125, None, None]


def test_split_at_links_keeps_the_text(spark):
    it = items(spark, [("one two three", 0.0, 100.0, 130.0, 10.0), ("free", 300.0, 100.0, 40.0, 10.0)])
    links = spark.createDataFrame([(1, 0, 0, "u", 45.0, 95.0, 200.0, 20.0)], "doc_id long, page int, ord int, url string, lx double, ly double, lw double, lh double")
    got = layout.split_at_links(it, links).orderBy("seq", "piece").collect()
    assert "".join(r.str for r in got if r.seq == 0) == "one two three"
    assert sum(r.w for r in got if r.seq == 0) == pytest.approx(130.0)
    assert len([r for r in got if r.seq == 0]) == 2


def run_stream(spark, tmp_path, name, make, rows, schema, mode):
    """The rows that a stream over two files gives, a file a micro-batch."""
    half = len(rows) // 2
    for k, part in enumerate((rows[:half], rows[half:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode(mode).start()
        q.awaitTermination(180)
    except Exception as e:  # the state server needs a package that may be missing
        if "ModuleNotFoundError" in str(e) or "No module named" in str(e):
            pytest.skip("transformWithState needs protobuf")
        raise
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.table(name).collect()


def test_assembly_of_united_tables_keeps_groups_whole(spark):
    """Both parts are dealt by the key already, but the smaller one into fewer partitions."""
    conf = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20kb"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        lines = spark.range(4000).select((F.col("id") % 1000).alias("group_key"), F.floor(F.col("id") / 1000).alias("idx"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
        lines = lines.withColumn("total", F.count("*").over(Window.partitionBy("group_key")))
        first = lines.select("group_key", F.col("idx").alias("seq"), "idx", "total", "text").where("idx < 3")
        last = lines.select("group_key", F.col("idx").alias("seq"), "idx", "total", F.lit("x").alias("text")).where("idx = 3")
        assert jobs.assemble(first.unionByName(last)).where("n = 1 AND endswith(body, 'x')").count() == 1000
    finally:
        for k in conf:
            spark.conf.unset(k)


def test_assembly_stream_equals_batch(spark, tmp_path):
    rows = [(g, n, *r) for n, (g, *r) in enumerate(PARTS)]
    # cut inside the groups: state goes from one micro-batch to the next
    got = run_stream(spark, tmp_path, "assembled", jobs.assemble_stream, sorted(rows, key=lambda r: r[1] % 7 >= 3 and r[0] > 3), PART, "append")
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in jobs.assemble(spark.createDataFrame(rows, PART)).collect()) == WHOLE


def test_replay_stream_equals_batch(spark, tmp_path):
    ops = ["execute", "execute", "undo", "redo", "undo", "execute", "redo", "undo", "undo", "undo", "execute", "execute"]
    rows = [(k, n, op, 100 * k + n) for n, op in enumerate(ops) for k in (1, 2, 3) if (n + k) % 4]
    schema = "key long, seq long, op string, id long"
    got = run_stream(spark, tmp_path, "replayed", jobs.replay_stream, rows, schema, "update")
    last = {r.key: r.commands for r in got}
    assert last == {r.key: r.commands for r in jobs.replay(spark.createDataFrame(rows, schema)).collect()} and len(got) == 6


def test_saved_table_takes_each_batch_once(spark, tmp_path):
    schema = "key long, saved_at timestamp, value double"
    rows = lambda *r: spark.createDataFrame(r, "key long, s long, value double").select("key", F.timestamp_seconds("s").alias("saved_at"), "value")
    saved = jobs.SavedTable(str(tmp_path / "saved"), schema, whole_every=3)
    now = lambda: {r.key: r.value for r in saved.read(spark).collect()}
    assert now() == {}
    saved(rows((1, 10, 1.0), (2, 10, 2.0)), 0)
    saved(rows((1, 20, 3.0)), 1)
    assert now() == {1: 3.0, 2: 2.0}
    # the same number again, whatever it holds, and a late save
    saved(rows((1, 99, 9.0)), 1)
    saved(rows((1, 5, 8.0), (3, 5, 5.0)), 2)
    assert now() == {1: 3.0, 2: 2.0, 3: 5.0}
    # an attempt that wrote its rows and was not committed counts for nothing, and is written over
    rows((1, 500, 7.0)).write.parquet(str(tmp_path / "saved/data/3"))
    assert now() == {1: 3.0, 2: 2.0, 3: 5.0}
    for n in range(3, 9):
        saved(rows((1, 30 + n, float(n)), (n, n, 0.0)), n)
    assert now() == {1: 8.0, 2: 2.0, 3: 5.0, **{n: 0.0 for n in range(4, 9)}}
    assert [w for _, w in saved._commits(spark)].count(True) == 1 and len(saved._commits(spark)) <= 3


def test_stream_of_saves(spark, tmp_path):
    rows = [(k, t, t, float(t)) for k in range(3) for t in (0, 1, 2, 100, 101)] + [(9, 10_000, 1, 0.0)]
    df = spark.createDataFrame(rows, "key long, s long, tie long, value double").select("key", F.timestamp_seconds("s").alias("ts"), "tie", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run has nothing new
        q = jobs.save_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path / "saved"), str(tmp_path / "cp"), gap="10 seconds").trigger(availableNow=True).start()
        q.awaitTermination(180)
    saved = jobs.SavedTable(str(tmp_path / "saved"), "key long, saved_at timestamp, value double")
    assert {(r.key, r.value) for r in saved.read(spark).collect()} == {(k, 101.0) for k in range(3)}


def cut_of(spark, rows, width=600.0):
    """rows of <x, y, w>, size 10: the cut of their page."""
    df = spark.createDataFrame([(1, 0, k, float(x), float(y), float(w), 10.0) for k, (x, y, w) in enumerate(rows)], "doc_id long, page int, seq long, x double, y double, w double, size double")
    got = layout.column_cut(df, spark.createDataFrame([(1, 0, width)], "doc_id long, page int, page_width double")).collect()
    return got[0].cut if got else None


def test_geometry_of_paragraphs(spark):
    rows = [
        # justified, first line set in by 20; a list item 20 from the edge; centred; right; alone and far below
        (0, 0, 700.0, 70.0, 500.0, "a"), (0, 1, 688.0, 50.0, 500.0, "a"), (0, 2, 675.5, 50.0, 200.0, "a"),
        (1, 3, 650.0, 70.0, 300.0, " 1. x"), (1, 4, 638.0, 82.0, 300.0, "a"),
        (2, 5, 610.0, 250.0, 350.0, "a"), (3, 6, 580.0, 320.0, 500.0, "a"), (3, 7, 568.0, 400.0, 505.0, "a"), (4, 8, 400.0, 50.0, 500.0, "a"), (5, 9, 389.0, 50.0, 500.0, "a"),
    ]
    lines = spark.createDataFrame([(1, 0, p, k, y, 10.0, x0, x1, t) for p, k, y, x0, x1, t in rows], "doc_id long, page int, para int, line int, y double, size double, x0 double, x1 double, text string")
    pages = spark.createDataFrame([(1, 0, 600.0)], "doc_id long, page int, page_width double")
    got = [tuple(r)[3:10] for r in document.paragraph_geometry(lines, pages).orderBy("para").collect()]
    # the first line of the first paragraph is not at the edge, so that it is left
    assert got == [
        ("left", None, 20, 12.3, None, 16, None), ("left", 32, None, 12.0, 16, 18, 2), ("center", None, None, None, 18, 20, None),
        ("right", None, None, 12.0, 20, 60, None), ("left", None, None, None, 60, 1, None), ("left", None, None, None, 1, None, None),
    ]


def test_runs_of_a_paragraph(spark):
    rows = [
        # sizes climb: each is near the one before, the third is too far from the first
        (0, 0, 10.0, 0.0, 20.0, 10.0, "a", False), (0, 1, 32.0, 0.0, 20.0, 10.5, "b", False), (0, 2, 52.5, 0.0, 10.0, 11.0, "c", False),
        # a small raised word, one that is only small
        (0, 3, 62.5, 4.0, 5.0, 6.0, "2", False), (0, 4, 80.0, 0.0, 5.0, 6.0, "d", False),
        # on the next line, an Arabic phrase of two words inside of Latin ones: the blank is at the phrase's edge
        (1, 0, 10.0, -14.0, 20.0, 10.0, "e ", False), (1, 1, 70.0, -14.0, 20.0, 10.0, "س", True), (1, 2, 40.0, -14.0, 28.0, 10.0, "ل", True), (1, 3, 91.0, -14.0, 9.0, 10.0, "f", False), (1, 4, 103.0, -14.0, 9.0, 10.0, "g", False),
    ]
    words = spark.createDataFrame([(1, 0, 0, *r) for r in rows], "doc_id long, page int, para int, line int, pos int, x double, y double, w double, size double, str string, rtl boolean")
    got = [(r.text, r["size"], r.raised, r.rtl) for r in layout.paragraph_runs(words).orderBy("run").collect()]
    assert got == [("a b", 10.0, None, False), ("c", 11.0, None, False), ("2", 6.0, "super", False), (" d ", 6.0, None, False), ("e ", 10.0, None, False), ("س ل", 10.0, None, True), ("f g", 10.0, None, False)]


def test_gutters(spark):
    two = lambda gap, rows=30, left=50, wide=240: [(x, 700 - 14 * r, wide) for r in range(rows) for x in (left, left + wide + gap)]
    # bins of two points: 290 to 310 is free from 292 to 308
    assert cut_of(spark, two(20)) == 300.0
    # a page number, alone or beside another short word, does not close it; a long line does, as does a short piece inside of one
    assert cut_of(spark, [*two(20), (296, 30, 8)]) == 300.0
    assert cut_of(spark, [*two(20), (270, 30, 18), (296, 30, 8), (310, 30, 20)]) == 300.0
    assert cut_of(spark, [*two(20), (100, 30, 195), (302, 30, 190)]) is None
    assert cut_of(spark, [*two(20), (100, 30, 191), (298, 32, 8), (312, 30, 190)]) is None
    assert cut_of(spark, [*two(20), (296, 650, 8)]) is None
    # nine points are a gutter between two blocks only
    assert cut_of(spark, two(9)) == 294.0 and cut_of(spark, two(9, rows=19)) is None
    assert cut_of(spark, [(x, 700 - 14 * r, w) for r in range(30) for x, w in ((50, 100), (159, 300))]) is None
    # one row, three words, no words on one side
    assert cut_of(spark, two(20, rows=1)) is None and cut_of(spark, two(20)[:3]) is None and cut_of(spark, [(50, 700 - 14 * r, 100) for r in range(9)]) is None


def test_columns_are_cut_again(spark):
    rows = [(f"{c}{r}", x, 700.0 - 14 * r, 40.0, 12.0) for r in range(8) for c, x in enumerate((60.0, 240.0, 420.0))]
    got = {r.str: r.col for r in layout.split_columns(items(spark, rows), pages(spark)).collect()}
    assert got == {f"{c}{r}": c for r in range(8) for c in range(3)}
    once = {r.str: r.col for r in layout.split_columns(items(spark, rows), pages(spark), depth=1).collect()}
    assert len(set(once.values())) == 2


def test_slabs_with_few_lines_stay_whole(spark):
    full = [(f"f{r}", 60.0, 700.0 - 14 * r, 480.0, 12.0) for r in range(4)]
    two = lambda n: [(f"w{c}{r}", x, 580.0 - 14 * r, 160.0, 12.0) for r in range(n) for c, x in enumerate((60.0, 360.0))]
    got = {r.str: (r.slab, r.col) for r in layout.split_slabs(items(spark, full + two(7)), pages(spark)).collect()}
    assert {got[f"f{r}"] for r in range(4)} == {(0, 0)} and {got[f"w1{r}"] for r in range(7)} == {(1, 1)} and {got[f"w0{r}"] for r in range(7)} == {(1, 0)}
    assert {(r.slab, r.col) for r in layout.split_slabs(items(spark, full + two(4)), pages(spark)).collect()} == {(0, 0)}


def test_visual_strings_are_read_in_order():
    assert logical("مالس"[::1]) == "سلام" and logical("plain (1)") == "plain (1)" and logical(None) is None
    assert logical("(abc) مالس") == "سلام (abc)" and logical("12.5 مالس") == "سلام 12.5"


def test_tree_blocks(spark):
    role = {0: ("Document", None), 1: ("H2", 0), 2: ("L", 0), 3: ("LI", 2), 4: ("P", 3), 5: ("L", 3), 6: ("LI", 5), 7: ("Figure", 0), 8: ("P", 7), 9: ("Table", 0), 10: ("TR", 9), 11: ("TD", 10), 12: ("Span", 11), 13: ("P", 0)}
    nodes = spark.createDataFrame([(1, n, p, n, r) for n, (r, p) in role.items()], "doc_id long, node_id long, parent_id long, ord long, role string")
    its = spark.createDataFrame([(1, n, n, f"t{n}") for n in (1, 3, 4, 6, 8, 12)], "doc_id long, leaf_id long, seq long, str string")
    got = {r.node_id: (r.kind, r.level, r.depth, r.table_id, r.text) for r in tagged.tree_blocks(nodes, its).collect()}
    assert got == {1: ("heading", 2, 0, None, "t1"), 3: ("item", 0, 1, None, "t3 t4"), 6: ("item", 0, 2, None, "t6"), 11: ("cell", 0, 0, 9, "t12")}


def test_tables_of_trees(spark):
    role = {
        0: ("Document", None), 1: ("Table", 0), 2: ("TR", 1), 3: ("TH", 2), 4: ("TD", 2), 5: ("TBody", 1), 6: ("TR", 5), 7: ("TD", 6), 8: ("P", 7), 9: ("Table", 7), 10: ("TR", 9), 11: ("td", 10), 12: ("TR", 5), 13: ("Span", 12),
        # rows that are no table's, a table without text
        14: ("Sect", 0), 15: ("TR", 14), 16: ("TD", 15), 17: ("Table", 0), 18: ("TR", 17), 19: ("TD", 18), 20: ("Span", 3), 21: ("Span", 3),
    }
    nodes = spark.createDataFrame([(1, n, p, n, r) for n, (r, p) in role.items()], "doc_id long, node_id long, parent_id long, ord long, role string")
    its = spark.createDataFrame([(1, 21, 0, "after"), (1, 20, 1, "first"), (1, 8, 2, "in  p"), (1, 11, 3, "inner"), (1, 7, 4, "own"), (1, 16, 5, "no"), (1, 13, 6, "no"), (1, 19, 7, " ")], "doc_id long, leaf_id long, seq long, str string")
    got = {(r.table_id, r.r, r.c): r.text for r in tagged.tree_tables(nodes, its).collect()}
    assert got == {(1, 0, 0): "first after", (1, 0, 1): "", (1, 1, 0): "own in p", (1, 1, 1): "", (1, 2, 0): "", (1, 2, 1): "", (9, 0, 0): "inner"}


def test_elements_follow_a_turned_page(spark):
    point = "array<struct<x: double, y: double>>"
    el = spark.createDataFrame([(1, "box", 10.0, 20.0, 30.0, 40.0, None), (1, "arrow", 10.0, 20.0, 30.0, 40.0, [(10.0, 20.0), (40.0, 60.0)]), (2, "box", 1.0, 2.0, 3.0, 4.0, None)], f"page_id int, kind string, x double, y double, w double, h double, points {point}")
    turned = spark.createDataFrame([(1, 90, 600.0, 800.0)], "page_id int, turn int, page_w double, page_h double")
    got = {(r.page_id, r.kind): (r.x, r.y, r.w, r.h) for r in manifest.rotate_elements(el, turned).collect()}
    assert got == {(1, "box"): (745.0, 5.0, 30.0, 40.0), (1, "arrow"): (740.0, 10.0, 40.0, 30.0), (2, "box"): (1.0, 2.0, 3.0, 4.0)}


def test_undecided_lines(spark):
    row = lambda para, line, right, left, x0, x1: (1, 0, para, line, right, left, x0, x1, 10.0, 0.0, 100.0)
    rows = [
        # the paragraph's letters are decided
        row(0, 0, 11, 1, 0.0, 100.0), row(0, 1, 4, 6, 0.0, 100.0),
        # flush with one side; a full line takes the side of the others that are flush with one
        row(1, 2, 4, 6, 40.0, 100.0), row(1, 3, 4, 6, 0.0, 100.0), row(1, 4, 6, 4, 0.0, 60.0),
        row(2, 5, 4, 6, 40.0, 100.0), row(2, 6, 4, 6, 0.0, 100.0), row(2, 7, 6, 4, 0.0, 100.0),
        # nothing says otherwise: lines stay as they are
        row(3, 8, 6, 4, 0.0, 100.0), row(3, 9, 4, 6, 30.0, 60.0), row(3, 10, 0, 0, 0.0, 100.0),
    ]
    lines = spark.createDataFrame(rows, "doc_id long, page int, para int, line int, right int, left int, x0 double, x1 double, size double, c0 double, c1 double")
    assert {r.line: r.rtl for r in tagged.settle_lines(lines).collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: True, 6: True, 7: True, 8: True, 9: False, 10: False}


def rows_of(spark, items):
    """items of <x, y, width, height, text>: each row's text and direction."""
    df = spark.createDataFrame([(1, 0, k, float(x), float(y), float(w), float(h), float(h), t) for k, (x, y, w, h, t) in enumerate(items)], "doc_id long, page int, seq long, x double, y double, w double, height double, size double, str string")
    got = tagged.logical_lines(df).orderBy("line", "pos").collect()
    assert all(r.text[r.start : r.start + len(r.read)] == r.read for r in got)
    return [(r.text, r.rtl) for r in got if r.pos == 1]


def test_rows_of_signs_make_words(spark):
    # signs 6 wide and 10 high: gaps over 1.5 are blanks, small shifts of the baseline stay in the row
    signs = [(10 + 6 * k, 700 + k % 2, 6, 10, c) for k, c in enumerate("abc")] + [(30, 701, 6, 10, "d"), (36, 700, 6, 10, "e"), (10, 680, 6, 10, "x")]
    assert rows_of(spark, signs) == [("abc de", False), ("x", False)]
    # word items are several sizes wide, yet a blank is at most 0.15 sizes
    assert rows_of(spark, [(10, 700, 50, 10, "first"), (61, 700, 50, 10, "second"), (113, 700, 50, 10, "third")]) == [("firstsecond third", False)]


def test_rows_of_arabic_signs(spark):
    # drawn from the right; a number goes with the line, a Latin word stays forward
    word = [(100 - 6 * k, 700, 6, 10, c) for k, c in enumerate("سلام")]
    assert rows_of(spark, word) == [("سلام", True)]
    assert rows_of(spark, [*word, (60, 700, 12, 10, "20"), (40, 700, 6, 10, "v"), (46, 700, 6, 10, "w"), (20, 700, 6, 10, "ب")]) == [("سلام 20 vw ب", True)]
    # more items of one letter than others with letters make the row's direction
    assert rows_of(spark, [(100, 700, 6, 10, "س"), (10, 700, 40, 10, "long"), (60, 700, 30, 10, "text")]) == [("long text س", False)]


def test_large_numerals(spark):
    r = spark.range(1).select(text.roman(F.lit(4001)).alias("r"), text.letters_of(F.lit(703)).alias("l"), text.is_roman(F.lit("iiii")).alias("bad"), text.is_roman(F.lit("mcmxciv")).alias("good")).first()
    assert (r.r, r.l, r.bad, r.good) == ("mmmmi", "aaa", False, True)


def test_genre_gate_sees_spaced_leaders(spark):
    cells = [(1, 0, r, 0, f"Chapter . . . . {r} ") for r in range(5)] + [(2, 0, r, 0, f"term {r}, 12-14, 20 ") for r in range(5)] + [(3, 0, r, 0, "plain words") for r in range(5)]
    df = spark.createDataFrame(cells, "doc_id long, page int, r int, c int, text string")
    got = {r.doc_id: (r.is_index, r.is_contents) for r in tables.genre_gate(df).collect()}
    assert got[1][1] and got[2] == (True, False) and got[3] == (False, False)


def test_debounced_stream(spark, tmp_path):
    rows = [(k, t, t, float(t)) for k in range(3) for t in (0, 1, 2, 100, 101)] + [(9, 10_000, 1, 0.0)]
    df = spark.createDataFrame(rows, "key long, s long, tie long, value double").select("key", F.timestamp_seconds("s").alias("ts"), "tie", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.debounce_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), gap="10 seconds")
    q = stream.writeStream.format("memory").queryName("debounced").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination(120)
    got = {(r.key, r.value) for r in spark.table("debounced").collect()}
    assert got == {(k, v) for k in range(3) for v in (2.0, 101.0)}
    state = jobs.upsert_saved(spark.table("debounced"), spark.table("debounced").limit(0))
    assert {(r.key, r.value) for r in state.collect()} == {(k, 101.0) for k in range(3)}


def test_links_cut_at_words(spark):
    """Left edges go to the start of a word, right edges to the end of one; turned and right-to-left items stay whole."""
    it = items(spark, [("see (example) now", 0.0, 100.0, 170.0, 10.0), ("see (example) now", 0.0, 300.0, 170.0, 10.0), ("سلام عليكم", 0.0, 100.0, 100.0, 10.0), ("......", 0.0, 100.0, 60.0, 10.0)])
    it = it.withColumn("a", F.when(F.col("seq") == 1, 0.0).otherwise(F.col("a"))).withColumn("b", F.when(F.col("seq") == 1, 10.0).otherwise(F.col("b")))
    links = spark.createDataFrame([(1, 0, 0, "u", 42.0, 86.0, 0.0, 400.0)], "doc_id long, page int, ord int, url string, lx double, ly double, lw double, lh double")
    got = {}
    for r in layout.split_at_links(it, links.withColumn("ly", F.lit(0.0)).withColumn("lw", F.lit(86.0))).orderBy("seq", "piece").collect():
        got.setdefault(r.seq, []).append((r.str, r.x, r.w))
    assert got[0] == [("see (", 0.0, 50.0), ("example", 50.0, 70.0), (") now", 120.0, 50.0)]
    assert [len(got[k]) for k in (1, 2)] == [1, 1]
    assert [p[0] for p in got[3]] == ["....", ".."]


def test_rules_are_what_a_clip_shows_of_them(spark):
    rows = [("cut", 0.0, 0.0, 100.0, 2.0, 50.0, 0.0, 60.0, 9.0), ("free", 0.0, 0.0, 100.0, 2.0, None, None, None, None), ("gone", 0.0, 0.0, 100.0, 2.0, 100.0, 0.0, 200.0, 9.0), ("block", 0.0, 0.0, 40.0, 40.0, 0.0, 0.0, 40.0, 2.0), ("short", 0.0, 0.0, 2.0, 90.0, 0.0, 10.0, 5.0, 11.0)]
    df = spark.createDataFrame(rows, "name string, x double, y double, w double, h double, cx0 double, cy0 double, cx1 double, cy1 double")
    got = {r.name: (r.kind, r.x, r.y, r.w, r.h) for r in tables.classify_rules(df).collect()}
    assert got == {"cut": ("horizontal", 50.0, 0.0, 10.0, 2.0), "free": ("horizontal", 0.0, 0.0, 100.0, 2.0), "short": ("vertical", 0.0, 10.0, 2.0, 1.0)}


def plain_markers(rows):
    """The innermost own marker at each item, by a stack."""
    stack, seen, out = [], {}, {}
    for seq, kind, tag, own in rows:
        if kind == "begin":
            if own:
                seen[tag] = seen.get(tag, -1) + 1
            stack.append((tag, seen[tag]) if own else None)
        elif kind == "end":
            if stack:
                stack.pop()
        else:
            out[seq] = next((m for m in reversed(stack) if m), (None, None))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_open_markers_by_a_stack(spark, seed):
    import random

    rng = random.Random(seed)
    pages_of = {p: [(s, rng.choice(["item", "item", "begin", "end", "end" if seed else "begin"]), rng.choice("AB"), rng.random() < 0.6) for s in range(80)] for p in range(12)}
    rows = [(1, p, s, k, t if k == "begin" else None, o if k == "begin" else None) for p, r in pages_of.items() for s, k, t, o in r]
    got = reconcile.open_markers(spark.createDataFrame(rows, "doc_id long, page int, seq long, kind string, tag string, own boolean"))
    found = {(r.page, r.seq): (r.m_tag, r.m_k) for r in got.where("kind = 'item'").collect()}
    assert found == {(p, s): m for p, r in pages_of.items() for s, m in plain_markers(r).items()}


def test_clips_hide_items_of_pages_that_agree(spark):
    it = spark.createDataFrame([(1, p, s, w, 10.0 * s, 50.0, 8.0, 10.0) for p in range(5) for s, w in enumerate(["a", "b", "c"])], "doc_id long, page int, seq long, str string, x double, y double, w double, size double")
    stream = []
    for p in range(5):
        stream += [(1, p, 0, "item", None, None, "a", 0.0, 50.0), (1, p, 1, "begin", "F", True, None, None, None), (1, p, 2, "item", None, None, "B" if p == 1 else "b", 10.009, 50.0), (1, p, 3, "end", None, None, None, None, None), (1, p, 4, "item", None, None, "c", 20.0, 50.02 if p == 2 else 50.0)]
    marked = spark.createDataFrame(stream, "doc_id long, page int, seq long, kind string, tag string, own boolean, str string, x double, y double")
    clips = spark.createDataFrame([(1, p, "F", k, 0.0, 0.0, 9.0, 99.0) for p in (0, 1, 2) for k in (0,)] + [(1, 3, "F", k, 0.0, 0.0, 9.0, 99.0) for k in (0, 1)], "doc_id long, page int, tag string, k long, cx0 double, cy0 double, cx1 double, cy1 double")
    # a text, a place, a clip too many and one that is missing refuse pages 1 to 4
    got = sorted((r.page, r.seq, r.m_tag, r.hidden) for r in reconcile.carry_clips(it, marked, clips).collect())
    assert got == [(0, 0, None, False), (0, 1, "F", True), (0, 2, None, False)]


def test_fields_go_out_as_their_values(spark):
    widgets = spark.createDataFrame(
        [(1, "list", 1, "list", "a\nb", False), (1, "none", 2, "list", "a", False), (1, "box", 3, "checkbox", None, False), (1, "unset", 4, "checkbox", None, False), (1, "hid", 5, "text", "x", False), (1, "hid", 6, "text", "x", True), (1, "text", 7, "text", "a\nb", False), (1, "text", 8, "text", "later", False)],
        "src_id long, name string, ord long, kind string, source_value string, redacted boolean",
    )
    values = spark.createDataFrame([(1, "none", ""), (1, "box", "")], "src_id long, name string, value string")
    assert {r.name: r["values"] for r in reconcile.export_fields(widgets, values).collect()} == {"list": ["a", "b"], "box": ["Off"], "text": ["a\nb"]}


def test_bold_paragraphs_are_headings(spark):
    rows = [("Bold words", True, False, False), ("Bold but ruled", True, True, False), ("Bold and turned", True, False, True), ("Only plain", False, False, False), ("OK", True, False, False), ("ALL UPPER", None, None, None), ("• Bold item", True, False, False), ("one two three four five six seven eight nine", True, False, False)]
    paras = spark.createDataFrame([(1, i, t, 10.0, 0, b, r, u) for i, (t, b, r, u) in enumerate(rows)], "doc_id long, ord long, text string, size double, level int, bold boolean, ruled boolean, turned boolean")
    got = document.promote_headings(paras, spark.createDataFrame([(1, 10.0)], "doc_id long, body double"))
    assert {r.text for r in got.where("level = 3").collect()} == {"Bold words", "ALL UPPER"}


def test_destinations_by_kind(spark):
    nan = float("nan")
    rows = [(1, 0, 0, "XYZ", [1.0, 700.0, 0.0]), (1, 1, 0, "FitBH", [50.0]), (1, 2, 1, "FitR", [0.0, 1.0, 2.0, 3.0]), (1, 3, 1, "Fit", []), (1, 4, 0, "XYZ", [1.0, None, 0.0]), (1, 5, 2, "XYZ", [0.0, 1.0, 0.0]), (1, 6, -1, "Fit", []), (1, 7, 0, "FitH", [nan]), (1, 8, 0, "FitH", [])]
    df = spark.createDataFrame(rows, "doc_id long, target long, page int, kind string, args array<double>")
    got = document.destinations(df, spark.createDataFrame([(1, 2)], "doc_id long, n_pages int"))
    assert {r.target: r.top for r in got.collect()} == {0: 700.0, 1: 50.0, 2: 3.0, 3: None, 4: None, 7: None, 8: None}


def test_texts_with_runs_tables_and_images(spark):
    run = "struct<text:string,bold:boolean,italic:boolean,url:string,anchor:string>"
    rows = [
        (1, 0, 0, "Title", "", 0, 2, "b1", [("  Title ", True, True, None, None)]),
        (1, 0, 1, "item", "- ", 1, 1, None, [("a*b ", False, True, None, None), ("\\ c", None, None, None, "b1")]),
        (1, 1, 2, "x y", "", 0, 0, None, [("x ", False, False, " https://e.org/(1) ", None), ("y", True, False, "javascript:z", "b1"), (" ", True, True, None, None)]),
        (1, 1, 3, " ", "", 0, 0, None, [(" ", True, False, None, None)]),
    ]
    blocks = spark.createDataFrame(rows, f"doc_id long, page int, ord long, text string, marker string, depth int, level int, bookmark string, runs array<{run}>")
    grid = spark.createDataFrame([(1, 0, 0, [["h|1", "h\n2"], [" a  b ", ""]]), (1, 1, 0, [])], "doc_id long, page int, ord long, cells array<array<string>>")
    images = spark.createDataFrame([(1, 0, 0, "image/png", "AAAA")], "doc_id long, page int, ord long, mime string, data string")
    md = document.render_markdown(blocks, tables=grid, images=images).first().body
    assert md.split("\n\n") == [
        '## <a id="b1"></a>***Title***', "  - *a\\*b* [\\\\ c](#b1)", "| h\\|1 | h 2 |\n| --- | --- |\n| a  b |  |", "![image](data:image/png;base64,AAAA)", "[x](https://e.org/%281%29) **y** ",
    ]
    plain = document.render_text(blocks, tables=grid, images=images).first().body
    assert plain.split("\n\n") == ["Title", "  - item", "h|1\th 2\na b\t", "[image]", "x y"]


def test_overlay_texts_in_reading_order(spark):
    rows = [(1, 0, 50.0, 10.0, 12.0, "low", "#000000", "Arial"), (1, 1, 9.0, 5.0, 10.0, "right\n \n  two", "#a0b1c2", "Courier"), (1, 2, 2.0, 5.0, 10.0, "سلام", None, "Minion Pro"), (1, 3, 0.0, 1.0, 10.0, None, "", None)]
    el = spark.createDataFrame([(*r, 100.0) for r in rows], "page long, ord int, x double, y_down double, font_size double, text string, color string, font_family string, page_height double")
    got = [tuple(r) for r in ocr.overlay_paragraphs(el, ["page"]).orderBy("para").drop("page").collect()]
    assert got == [(0, 2, 0, "سلام", 95.0, True, None, "serif"), (1, 1, 0, "right", 95.0, False, "A0B1C2", "monospace"), (2, 1, 1, "  two", 85.0, False, "A0B1C2", "monospace"), (3, 0, 0, "low", 90.0, False, None, "sans-serif")]


def test_stamps_of_pages_and_their_places(spark):
    df = spark.range(3).selectExpr("id AS page_id").repartition(3)
    assert [r.stamp for r in manifest.stamp_pages(df, mode="page").orderBy("n").collect()] == ["1 / 3", "2 / 3", "3 / 3"]
    at = spark.createDataFrame([("tl",), ("tc",), ("br",)], "pos string").selectExpr("*", "100D AS page_width", "200D AS page_height", "20D AS text_w", "10D AS font_size")
    x, y = manifest.stamp_origin(F.col("pos"), 5.0)
    assert {r.pos: (r.x, r.y) for r in at.select("pos", x.alias("x"), y.alias("y")).collect()} == {"tl": (5.0, 185.0), "tc": (40.0, 185.0), "br": (75.0, 5.0)}
    assert manifest.stamp_pages(df.limit(0), mode="page").count() == 0


def test_a_page_cap_counts_all_kinds_of_matches(spark):
    it = items(spark, [("the other", 0.0, 100.0, 90.0, 10.0), ("ｔｈｅ", 100.0, 100.0, 30.0, 10.0), ("nothing", 200.0, 100.0, 70.0, 10.0), ("THE", 0.0, 80.0, 30.0, 10.0)])
    got = [(r.n, r.kind, r.place, r.start) for r in tagged.search_pages(it, "the").orderBy("n").collect()]
    assert got == [(1, "item", 0, 0), (2, "item", 0, 5), (3, "form", 1, 0), (4, "item", 3, 0)]
    assert tagged.search_pages(it, "the", cap=2).count() == 2 and tagged.search_pages(it, " ").count() == 0
    arabic = items(spark, [("لا", 20.0, 100.0, 10.0, 10.0), ("س", 30.0, 100.0, 5.0, 10.0), ("the", 0.0, 60.0, 30.0, 10.0)])
    lines = tagged.search_pages(arabic, "سلا").collect()
    assert [(r.kind, r.n) for r in lines] == [("line", 1)] and (lines[0].x0, lines[0].x1) == (20.0, 35.0)


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 3), (50, 51)], "src long, dst long")
    got = sorted(r.node for r in reconcile.reachable(edges, spark.createDataFrame([(0,)], "node long")).collect())
    assert got == list(range(21))
