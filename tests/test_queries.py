"""Every registered query that has SQL gives the SQL's rows on the smallest tables."""

import math
import re
from collections import Counter

import pytest

from folioflow.plans import registry
from folioflow.plans.tagged_queries import SPANNING


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, oracle, small, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = oracle.execute(registry.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want


def plain_lines(spark, small):
    """The derived items in plain Python: (doc_id, page) to rows of <number, text> from the top, words from left to right."""
    out = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect():
        for seq, word in enumerate((r.text or "").split(" ")):
            if word.strip():
                out.setdefault((r.doc_id, seq // 600), {}).setdefault(seq % 600 // 12, []).append((seq, word))
    return out


def test_slabs_part_full_rows_from_columns(spark, small):
    """Ten full rows, a white band, then two columns that count where both have six lines or more and few numbers."""
    got = {(r.doc_id, r.page, r.seq): (r.slab, r.col) for r in registry.QUERIES["w8_split_slabs"](spark, small).collect()}
    seen = set()
    for (doc, page), rows in plain_lines(spark, small).items():
        low = {n: w for n, w in rows.items() if n >= 10}
        sides = [[(n, s, t) for n, w in low.items() for s, t in w if (s % 12 >= 6) == right] for right in (False, True)]
        full = len({n for n, _, _ in sides[1]}) >= 6 and len(rows) > 12 and all(s in {x % 12 for n in range(10) for x, _ in rows.get(n, [])} for s in range(12))
        if full:
            for n, w in rows.items():
                for s, _ in w:
                    where = got[doc, page, s]
                    seen.add(where)
                    assert n >= 10 or where == (0, 0)
        else:
            assert all(got[doc, page, s][0] >= 0 for w in rows.values() for s, _ in w)
    assert seen == {(0, 0), (1, 0), (1, 1)}


def test_line_search_finds_what_spans_words(spark, small):
    """Rows of Latin words in plain Python: a blank where a gap is wide enough, and every match of the query with the words that it touches."""
    want = Counter()
    for (doc, page), rows in plain_lines(spark, small).items():
        words = [(seq, w) for row in rows.values() for seq, w in row]
        heights = sorted(h for seq, _ in words if (h := 0 if seq % 50 == 8 else 18 if seq % 600 < 12 else 12))
        widths = sorted(5 * len(w) for _, w in words)
        blank = min(0.4 * widths[len(widths) // 2], 0.15 * (heights[len(heights) // 2] if heights else 10))
        for number, (_, row) in enumerate(sorted(rows.items())):
            line, spans, end = "", [], None
            for seq, w in row:
                x = 72 + seq % 12 * 40
                line += " " * (end is not None and x - end > blank)
                spans.append((len(line), len(line) + len(w), x, x + 5 * len(w)))
                line += w
                end = x + 5 * len(w)
            for m in re.finditer("(?i)" + re.escape(SPANNING), line):
                touched = [s for s in spans if s[0] < m.end() and m.start() < s[1]]
                want[doc, page, number, m.start(), m.group(), min(s[2] for s in touched), max(s[3] for s in touched)] += 1
    got = Counter((r.doc_id, r.page, r.line, r.start, r.found, r.x0, r.x1) for r in registry.QUERIES["x3_search_lines"](spark, small).collect())
    assert len(want) > 10 and got == want


def test_replayed_logs(spark, small):
    """Undo, redo and execute over each user's events, in plain Python."""
    logs = {}
    for r in spark.read.parquet(f"{small}/events.parquet").orderBy("user_id", "ts", "event_id").collect():
        done, undone = logs.setdefault(r.user_id, ([], []))
        if r.event_type == "error":
            if done:
                undone.append(done.pop())
        elif r.event_type == "signup":
            if undone:
                done.append(undone.pop())
        else:
            done.append(r.event_id)
            del done[:-50]
            undone.clear()
    assert {r.key: r.commands for r in registry.QUERIES["q2_replay"](spark, small).collect()} == {k: d for k, (d, _) in logs.items()}


def test_pieces_at_links_are_their_items(spark, small):
    whole = {(r.doc_id, r.page, r.seq): (r.str, r.w) for r in registry.QUERIES["s1_items"](spark, small).collect()}
    pieces = {}
    for r in sorted(registry.QUERIES["j7_split_at_links"](spark, small).collect(), key=lambda r: r.piece):
        text, w = pieces.get((r.doc_id, r.page, r.seq), ("", 0.0))
        pieces[r.doc_id, r.page, r.seq] = (text + r.str, w + r.w)
    assert set(pieces) == set(whole) and all(pieces[k][0] == s and abs(pieces[k][1] - w) < 1e-6 for k, (s, w) in whole.items())


def test_cleaned_pages_keep_their_text(spark, small):
    rows = registry.QUERIES["x6_clean_html"](spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/pages.parquet").count()
    for r in rows:
        html = (r.asDict().get("cleaned") or r.asDict().get("html") or "").lower()
        assert "<script" not in html and "javascript:" not in html and " onclick" not in html


def test_csv_and_markdown_corpora(spark, small):
    csv = registry.QUERIES["e2_table_csv"](spark, small).collect()
    assert csv and all(r.line.count('"') % 2 == 0 for r in csv)
    docs = spark.read.parquet(f"{small}/documents.parquet").count()
    body = registry.QUERIES["e1_markdown_corpus"](spark, small).collect()
    assert 0.9 * docs <= len(body) <= docs and all(r.body.strip() for r in body)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_parts_of_texts_grow_with_the_texts(spark, small, monkeypatch):
    """Adaptive execution sizes parts by the texts, of which one part's items may not fit into memory."""
    from folioflow.sources import derived

    derived._tasks.cache_clear()
    monkeypatch.setattr(derived, "TASK_BYTES", 20_000)
    size = derived.table(spark, small, "documents").selectExpr("sum(octet_length(text))").first()[0]
    try:
        parts = derived.raw_items(spark, small).rdd.glom().map(len).collect()
        assert len(parts) == -(-size // 20_000) > 4
        assert sum(p > 0 for p in parts) > 4
    finally:
        derived._tasks.cache_clear()


def test_joins_of_items_shuffle_texts_alone(spark, small):
    plan = registry.QUERIES["j7_split_at_links"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"Exchange hashpartitioning.*?\), (\w+)", plan) and "ENSURE_REQUIREMENTS" not in plan


def test_cuts_are_made_for_hits_only(spark, small):
    """The places of cuts, told by patterns, are no part of the condition that every pair of item and edge is held against."""
    plan = registry.QUERIES["j7_split_at_links"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join Inner" in line]
    assert joins and not any("RLIKE" in line for line in joins)
