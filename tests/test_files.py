"""Files of documents: what is written is read again, failed writes leave nothing, names and marks are kept."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioflow.operators import annots
from folioflow.sources import files


def test_round_trip(spark, tmp_path):
    rows = [(f"a/b {k} é%", f"\ufeffbody {k}\r\nline" if k == 3 else f"body {k}\n") for k in range(20)] + [("empty", ""), ("null", None)]
    files.write_files(spark.createDataFrame(rows, "name string, body string").repartition(3), str(tmp_path / "out"), suffix=".txt")
    got = {r.name: r.body for r in files.read_files(spark, str(tmp_path / "out"), suffix=".txt").collect()}
    assert got == {n: (b or "").removeprefix("\ufeff") for n, b in rows}
    # another write adds, or takes the place of what is there
    more = spark.createDataFrame([("new", "x")], "name string, body string")
    files.write_files(more, str(tmp_path / "out"), suffix=".txt")
    assert files.read_files(spark, str(tmp_path / "out"), suffix=".txt").count() == len(rows) + 1
    files.write_files(more, str(tmp_path / "out"), suffix=".txt", mode="overwrite")
    assert [r.name for r in files.read_files(spark, str(tmp_path / "out"), suffix=".txt").collect()] == ["new"]
    assert not list(Path(tmp_path / "out/_open").iterdir())


def test_failed_writes_leave_nothing(spark, tmp_path):
    rows = [(None if k == 17 else f"n{k}", "x") for k in range(20)]
    with pytest.raises(Exception, match="needs a name"):
        files.write_files(spark.createDataFrame(rows, "name string, body string").repartition(4), str(tmp_path / "out"))
    assert not [p for p in Path(tmp_path / "out").rglob("*") if p.is_file()]


def test_nothing_to_write(spark, tmp_path):
    files.write_files(spark.createDataFrame([], "name string, body string"), str(tmp_path / "out"))
    assert files.read_files(spark, str(tmp_path / "out")).count() == 0


def test_csv_files(spark, tmp_path):
    lines = spark.createDataFrame([(1, 0, 1, '"b, c",2'), (1, 0, 0, "a,é"), (1, 2, 0, "z")], "doc_id long, page int, r int, line string")
    files.write_csv_files(lines, str(tmp_path / "out"))
    held = {p.name: p.read_bytes() for p in Path(tmp_path / "out").rglob("*.csv")}
    assert held == {"1-0.csv": b'\xef\xbb\xbfa,\xc3\xa9\r\n"b, c",2\r\n', "1-2.csv": b"\xef\xbb\xbfz\r\n"}
    assert {r.body for r in files.read_files(spark, str(tmp_path / "out"), suffix=".csv").collect()} == {'a,é\r\n"b, c",2\r\n', "z\r\n"}


def test_corpus_files(spark, tmp_path):
    docs = spark.createDataFrame([(7, "# Title\n\ntext"), (8, "é")], "doc_id long, body string")
    files.write_corpus_files(docs, str(tmp_path / "out"))
    assert {p.name: p.read_text() for p in Path(tmp_path / "out").rglob("*.md")} == {"7.md": "# Title\n\ntext", "8.md": "é"}


def test_fields_nest_and_come_back(spark, tmp_path):
    rows = [(1, 0, "a.b.c", ["1"]), (1, 1, "a.b", ["2", "<3>"]), (1, 2, "z", ['"q" & r']), (1, 3, "a.b.d", [""]), (1, 4, "a.bb", []), (1, 5, "z", ["last"]), (2, 0, "only", ["x"])]
    fields = spark.createDataFrame(rows, "doc_id long, ord int, name string, values array<string>")
    bodies = {r.doc_id: r.body for r in annots.write_fields(fields).collect()}
    assert bodies[1] == '<fields><field name="a"><field name="b"><value>2</value><value>&lt;3&gt;</value><field name="c"><value>1</value></field><field name="d"><value></value></field></field><field name="bb"></field></field><field name="z"><value>last</value></field></fields>'
    marks = spark.createDataFrame([(1, 0, "square", 2, [0.0, 1.0, 2.0, 3.0], None), (3, 0, "text", 0, [5.0, 1.0, 6.0, 3.0], "hi")], "doc_id long, ord long, kind string, page int, rect array<double>, contents string")
    marks = marks.withColumns({"quads": F.lit(None).cast("array<double>"), "line": F.lit(None).cast("array<double>"), "ink": F.lit(None).cast("array<array<array<double>>>"), "color": F.lit("#00ff00")})
    files.write_annot_files(marks, str(tmp_path / "out"), fields=fields)
    got, read = files.read_annot_files(spark, str(tmp_path / "out"))
    assert {(r.doc_id, r.kind, r.page, tuple(r.rect), r.contents) for r in got.collect()} == {("1", "square", 2, (0.0, 1.0, 2.0, 3.0), None), ("3", "text", 0, (5.0, 1.0, 6.0, 3.0), "hi")}
    assert {(r.doc_id, r["name"], tuple(r["values"])) for r in read.collect()} == {("1", "a.b.c", ("1",)), ("1", "a.b", ("2", "<3>")), ("1", "a.b.d", ("",)), ("1", "z", ("last",)), ("2", "only", ("x",))}


def test_unreadable_documents_have_no_fields(spark):
    docs = spark.createDataFrame([(1, "<xfdf><fields><field name='a'><value>1</value>"), (2, "<x xmlns='u'><fields><field><value>1</value></field><field name='k'><field name='m'><value>é</value></field></field></fields></x>"), (3, None)], "doc_id long, body string")
    assert [(r.doc_id, r["name"], r["values"]) for r in annots.read_fields(docs).collect()] == [(2, "k.m", ["é"])]
