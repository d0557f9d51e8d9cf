"""Registered queries of the layout and redaction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry, text
from folioflow.operators import layout, redact
from folioflow.sources import derived

from .base import Registry, with_tables

REGISTRY = Registry()
add = REGISTRY.add


def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.items_from_raw(derived.raw_items(spark, sf_dir))


def kept_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that no redaction covers."""
    pages = derived.pages(spark, sf_dir)
    return redact.redact_items(items_of(spark, sf_dir), derived.redactions(pages), pages)


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.baseline_texts(items_of(spark, sf_dir))


@add(with_tables("items") + " SELECT doc_id, page, seq, str, size, x, y, w FROM items")
def s1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spark, sf_dir).select("doc_id", "page", "seq", "str", "size", "x", "y", "w")


J1_SQL = """kept AS (SELECT i.* FROM items i WHERE NOT EXISTS (SELECT 1 FROM red r WHERE r.doc_id = i.doc_id AND r.page = i.page
 AND i.x < r.rx + r.rw AND r.rx < i.x + i.w AND i.y - 0.25 * i.size < 792 - r.ry_down AND 792 - r.ry_down - r.rh < i.y + i.size))"""


@add(with_tables("red") + f", {J1_SQL} SELECT doc_id, page, seq, str, x, y FROM kept")
def j1_redact_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_items(spark, sf_dir).select("doc_id", "page", "seq", "str", "x", "y")


@add(with_tables("red") + f""", {J1_SQL}
SELECT doc_id, page, max(y) AS y, string_agg(str, ' ' ORDER BY x, seq) AS text FROM kept GROUP BY doc_id, page, y""")
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: redaction, then lines of text."""
    return layout.baseline_texts(kept_items(spark, sf_dir)).select("doc_id", "page", "y", "text")


@add(with_tables("red") + """, annots AS (SELECT doc_id, page, seq, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0 THEN [x + w, y] ELSE [x + w, y + 10, x, y] END AS rect FROM items)
SELECT doc_id, page, seq FROM annots a WHERE NOT EXISTS (SELECT 1 FROM red r WHERE r.doc_id = a.doc_id AND r.page = a.page AND (a.rect IS NULL OR len(a.rect) <> 4
 OR (a.rect[3] < r.rx + r.rw AND r.rx < a.rect[1] AND a.rect[4] < 792 - r.ry_down AND 792 - r.ry_down - r.rh < a.rect[2])))""")
def j2_redact_annots(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    rect = F.when(F.col("seq") % 97 == 0, None).when(F.col("seq") % 89 == 0, F.array(F.col("x") + F.col("w"), "y")).otherwise(F.array(F.col("x") + F.col("w"), F.col("y") + 10, "x", "y"))
    annots = items.select("doc_id", "page", "seq", rect.alias("rect"))
    pages = derived.pages(spark, sf_dir)
    return redact.redact_annots(annots, derived.redactions(pages), pages).select("doc_id", "page", "seq")


@add(with_tables("red") + """, images AS (SELECT doc_id, page, seq, 40.0 AS a, 10.0 AS b, -10.0 AS c, 30.0 AS d, x AS e, y AS f FROM items)
SELECT doc_id, page, seq FROM images i WHERE NOT EXISTS (SELECT 1 FROM red r WHERE r.doc_id = i.doc_id AND r.page = i.page
 AND i.e - 10 < r.rx + r.rw AND r.rx < i.e + 40 AND i.f < 792 - r.ry_down AND 792 - r.ry_down - r.rh < i.f + 40)""")
def j3_redact_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    images = items.select("doc_id", "page", "seq", F.lit(40.0).alias("a"), F.lit(10.0).alias("b"), F.lit(-10.0).alias("c"), F.lit(30.0).alias("d"), F.col("x").alias("e"), F.col("y").alias("f"))
    pages = derived.pages(spark, sf_dir)
    return redact.redact_images(images, derived.redactions(pages), pages).select("doc_id", "page", "seq")


@add(with_tables("items") + """, el AS (SELECT doc_id, page, seq, CASE WHEN seq % 60 = 0 THEN 'redaction' ELSE 'text' END AS kind, x, 792 - y AS y, 30.0::DOUBLE AS w, 20.0::DOUBLE AS h, (seq % 2 * 90)::DOUBLE AS rot FROM items),
b AS (SELECT *, CASE WHEN rot = 90 THEN y - 5 ELSE y END AS y0, CASE WHEN rot = 90 THEN y + 25 ELSE y + 20 END AS y1, x AS x0, x + 30 AS x1 FROM el)
SELECT doc_id, page, seq, kind FROM b WHERE kind = 'redaction' OR NOT EXISTS (SELECT 1 FROM b r WHERE r.kind = 'redaction' AND r.doc_id = b.doc_id AND r.page = b.page AND b.x0 < r.x1 AND r.x0 < b.x1 AND b.y0 < r.y1 AND r.y0 < b.y1)""")
def j4_redact_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    el = items.select("doc_id", "page", "seq", F.when(F.col("seq") % 60 == 0, "redaction").otherwise("text").alias("kind"), "x", (792 - F.col("y")).alias("y"), F.lit(30.0).alias("w"), F.lit(20.0).alias("h"), (F.col("seq") % 2 * 90).cast("double").alias("rotation"))
    return redact.redact_elements(el).select("doc_id", "page", "seq", "kind")


@add(with_tables("items") + """, clips AS (SELECT doc_id, page, seq, CASE WHEN seq % 9 = 0 THEN x + 100 WHEN seq % 3 = 0 THEN x + 1 ELSE x - 9 END AS cx0, y - 2 AS cy0, CASE WHEN seq % 11 = 0 THEN x - 5 ELSE x + 140 END AS cx1, y + 8 AS cy1 FROM items)
SELECT doc_id, page, seq FROM items i WHERE NOT EXISTS (SELECT 1 FROM clips c WHERE c.doc_id = i.doc_id AND c.seq = i.seq AND (cx1 <= cx0 OR cy1 <= cy0 OR i.x + i.w < cx0 OR i.x > cx1 OR i.y + i.size < cy0 OR i.y - 0.25 * i.size > cy1))""")
def f5_drop_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    s, x = F.col("seq"), F.col("x")
    clips = items.select("doc_id", "page", "seq", F.when(s % 9 == 0, x + 100).when(s % 3 == 0, x + 1).otherwise(x - 9).alias("cx0"), (F.col("y") - 2).alias("cy0"), F.when(s % 11 == 0, x - 5).otherwise(x + 140).alias("cx1"), (F.col("y") + 8).alias("cy1"))
    return redact.drop_clipped(items, clips).select("doc_id", "page", "seq")


_BOXES = "boxes AS (SELECT doc_id, page, seq, x, y, CASE WHEN seq % 3 = 0 THEN w ELSE 1 END AS bw, CASE WHEN seq % 3 = 1 THEN w ELSE 1 END AS bh FROM items)"


@add(with_tables("items") + f""", {_BOXES}, seen AS (SELECT *, CASE WHEN seq % 5 = 1 THEN greatest(x, x + 8) ELSE x END AS vx0, CASE WHEN seq % 5 = 1 THEN least(x + bw, x + 20) ELSE x + bw END AS vx1 FROM boxes WHERE (bw > 2 AND bh < 8 AND bw > 3 * bh) OR (bh > 2 AND bw < 8 AND bh > 3 * bw))
SELECT doc_id, page, seq, CASE WHEN bw > 2 AND bh < 8 AND bw > 3 * bh THEN 'horizontal' ELSE 'vertical' END AS kind, vx0::DOUBLE AS x, (vx1 - vx0)::DOUBLE AS w FROM seen WHERE vx1 > vx0""")
def f1_classify_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.operators.tables import classify_rules

    s = F.col("seq")
    boxes = items_of(spark, sf_dir).select("doc_id", "page", "seq", "x", "y", F.when(s % 3 == 0, F.col("w")).otherwise(1.0).alias("w"), F.when(s % 3 == 1, F.col("w")).otherwise(1.0).alias("h"))
    cut = s % 5 == 1
    clips = {"cx0": F.when(cut, F.col("x") + 8), "cy0": F.when(cut, F.col("y") - 1), "cx1": F.when(cut, F.col("x") + 20), "cy1": F.when(cut, F.col("y") + 1000)}
    return classify_rules(boxes.withColumns(clips)).select("doc_id", "page", "seq", "kind", "x", "w")


_TURN = "turned AS (SELECT doc_id, page, seq, CASE WHEN seq % 10 = 3 THEN 'up' WHEN seq % 10 = 4 THEN 'down' END AS turned FROM items)"


@add(with_tables("items") + f", {_TURN} SELECT *, turned IS NOT NULL AND count(turned) OVER (PARTITION BY doc_id, page) < count(*) OVER (PARTITION BY doc_id, page) - count(turned) OVER (PARTITION BY doc_id, page) AS stamp FROM turned")
def f6_split_rotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("seq") % 10
    items = items_of(spark, sf_dir).withColumn("a", F.when(k.isin(3, 4), 0.0).otherwise(12.0)).withColumn("b", F.when(k == 3, 12.0).when(k == 4, -12.0).otherwise(0.0))
    return layout.split_rotated(items).select("doc_id", "page", "seq", "turned", "stamp")


@add(with_tables("items") + """, ru AS (SELECT doc_id, page, x + (seq % 3) * 4 AS x, y + (seq % 4) * 2 - 1 AS y, CASE WHEN seq % 6 = 0 THEN w ELSE 2.5 END AS rw, 1.0 AS rh FROM items)
SELECT i.doc_id, i.page, i.seq, coalesce(bool_or((ru.y + 0.5 - i.y) / i.size BETWEEN -0.35 AND 0.10), false) AS underline, coalesce(bool_or((ru.y + 0.5 - i.y) / i.size BETWEEN 0.18 AND 0.62), false) AS strike
FROM items i LEFT JOIN ru ON ru.doc_id = i.doc_id AND ru.page = i.page AND rw > 3 AND rw > 2 AND rh <= 0.18 * i.size AND least(i.x + i.w, ru.x + rw) - greatest(i.x, ru.x) >= 0.5 * i.w AND (ru.y + 0.5 - i.y) / i.size BETWEEN -0.35 AND 0.62
GROUP BY i.doc_id, i.page, i.seq""")
def j5_mark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    s = F.col("seq")
    # every item has a rule, most of them too short to count
    rules = items.select("doc_id", "page", (F.col("x") + s % 3 * 4).alias("x"), (F.col("y") + s % 4 * 2 - 1).alias("y"), F.when(s % 6 == 0, F.col("w")).otherwise(2.5).alias("w"), F.lit(1.0).alias("h"))
    return layout.mark_rules(items, rules).select("doc_id", "page", "seq", "underline", "strike")


@add(with_tables("links") + """, hit AS (SELECT i.doc_id, i.page, i.seq, min_by(url, ord) AS url FROM items i JOIN links l ON l.doc_id = i.doc_id AND l.page = i.page AND i.x + i.w / 2 BETWEEN lx AND lx + lw AND i.y + 0.4 * i.size BETWEEN ly AND ly + lh GROUP BY ALL)
SELECT i.doc_id, i.page, i.seq, url FROM items i LEFT JOIN hit USING (doc_id, page, seq)""")
def j6_tag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    return layout.tag_links(items, derived.links(derived.pages(spark, sf_dir))).select("doc_id", "page", "seq", "url")


@add()
def j7_split_at_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    return layout.split_at_links(items, derived.links(derived.pages(spark, sf_dir))).select("doc_id", "page", "seq", "piece", "str", "x", "w")


@add(with_tables("items") + """, col AS (SELECT doc_id, page, seq AS ord, CASE WHEN seq % 3 = 0 THEN x + 0.25 ELSE x + 7 END AS cx, y - 0.5 AS cy, CASE WHEN seq % 2 = 0 THEN 'aa0000' ELSE '0000bb' END AS color FROM items),
k AS (SELECT doc_id, page, floor(cx + 0.5) AS kx, floor(cy + 0.5) AS ky, max_by(color, ord) AS color FROM col GROUP BY ALL)
SELECT i.doc_id, i.page, i.seq, color FROM items i LEFT JOIN k ON k.doc_id = i.doc_id AND k.page = i.page AND floor(i.x + 0.5) = kx AND floor(i.y + 0.5) = ky""")
def j8_join_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    colors = items.select("doc_id", "page", F.col("seq").alias("ord"), F.when(F.col("seq") % 3 == 0, F.col("x") + 0.25).otherwise(F.col("x") + 7).alias("cx"), (F.col("y") - 0.5).alias("cy"), F.when(F.col("seq") % 2 == 0, "aa0000").otherwise("0000bb").alias("color"))
    return layout.join_colors(items, colors).select("doc_id", "page", "seq", "color")


@add(with_tables("rules") + """, v AS (SELECT DISTINCT doc_id, page, x FROM rules WHERE h > w),
j AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY doc_id, page ORDER BY x) > 3 THEN 1 ELSE 0 END AS jump FROM v),
n AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page ORDER BY x) AS cluster FROM j)
SELECT doc_id, page, cluster::INT AS cluster, avg(x) AS center FROM n GROUP BY ALL""")
def w1_cluster_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = derived.rules(derived.pages(spark, sf_dir)).where("h > w")
    return layout.cluster_positions(r, ["doc_id", "page"], "x")


_LINES = "lines AS (SELECT doc_id, page, ((seq % 600) // 12)::INT AS rowno, y, max(size) AS size, min(x) AS x0, max(x + w) AS x1, string_agg(str, ' ' ORDER BY x, seq) AS text FROM items GROUP BY ALL)"


@add(with_tables("items") + f", {_LINES} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) - 1)::INT AS line, y, size, x0, x1, text FROM lines")
def w3_cluster_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(spark, sf_dir)


@add(with_tables("items") + f", {_LINES} SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) - 1)::INT AS line, text FROM lines")
def w9_cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.joined_lines(layout.with_lines(items_of(spark, sf_dir), layout.LINE_COLUMNS)).select("doc_id", "page", "line", "text")


_NARROW = "narrow AS (SELECT doc_id, page, seq, x, y, size, CASE WHEN doc_id % 3 = 0 THEN 40.0 ELSE least(w, 30) END AS w, str FROM items)"


def narrow_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items_of(spark, sf_dir).withColumn("w", F.when(F.col("doc_id") % 3 == 0, 40.0).otherwise(F.least("w", F.lit(30.0))))


@add(with_tables("items") + f""", {_NARROW}, r AS (SELECT doc_id, page, x AS x1, max(x + w) OVER (PARTITION BY doc_id, page ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x0 FROM narrow)
SELECT doc_id, page, x0, x1 FROM r WHERE x1 - x0 >= 6""")
def w4_whitespace_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.whitespace_bands(narrow_items(spark, sf_dir))


_WIDE = """wide AS (SELECT doc_id, page, seq, size, CASE WHEN seq % 97 BETWEEN 5 AND 7 THEN 10.0 ELSE y END::DOUBLE AS y, CASE WHEN seq % 97 = 5 THEN 330 WHEN seq % 97 = 6 THEN CASE WHEN doc_id % 4 = 3 THEN 200 ELSE 100 END WHEN seq % 97 = 7 THEN CASE WHEN doc_id % 4 = 3 THEN 345 ELSE 500 END
 WHEN seq % 12 >= 6 THEN x + CASE doc_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 12 ELSE 9 END ELSE x END::DOUBLE AS x, CASE WHEN seq % 97 = 5 THEN 8 WHEN seq % 97 = 6 AND doc_id % 4 = 3 THEN 125 WHEN seq % 97 BETWEEN 6 AND 7 THEN 20 ELSE 40 END::DOUBLE AS w FROM items)"""
_CUT = f"""{_WIDE}, st AS (SELECT doc_id, page, min(y) + 0.05::DOUBLE * (max(y) - min(y)) AS foot, count(*) AS n, count(DISTINCT floor(y + 0.5)) AS rows, min(x + w / 2) AS low, max(x + w / 2) AS high FROM wide GROUP BY ALL),
op AS (SELECT st.*, (SELECT count(DISTINCT floor(y + 0.5)) >= 2 FROM wide v WHERE v.doc_id = st.doc_id AND v.page = st.page AND v.y > foot) AS open FROM st),
f AS (SELECT DISTINCT v.doc_id, v.page, v.x, v.y, v.w, v.size FROM wide v JOIN op USING (doc_id, page) WHERE open AND v.y <= foot AND v.w < 0.04::DOUBLE * 684),
ln AS (SELECT f.*, o.x AS ox, o.x + o.w AS ox1, CASE WHEN o.x > max(o.x + o.w) OVER (PARTITION BY f.doc_id, f.page, f.x, f.y, f.w, f.size ORDER BY o.x, o.w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 10 THEN 1 ELSE 0 END AS new
 FROM f JOIN wide o ON o.doc_id = f.doc_id AND o.page = f.page AND abs(o.y - f.y) <= greatest(4, 0.45::DOUBLE * f.size)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, x, y, w, size ORDER BY ox, ox1 - ox) AS run FROM ln),
rn AS (SELECT doc_id, page, x, y, w, size, run, max(ox1) - min(ox) AS reach, min(ox) AS a, max(ox1) AS b FROM isl GROUP BY ALL),
fol AS (SELECT DISTINCT doc_id, page, x, y, w FROM rn WHERE a <= x AND b >= x + w AND reach < 0.25::DOUBLE * 684),
used AS (SELECT DISTINCT doc_id, page, unnest(range(floor(x / 2)::INT, ceil((x + w) / 2)::INT + 1)) AS bin FROM wide ANTI JOIN fol USING (doc_id, page, x, y, w)),
free AS (SELECT doc_id, page, low, high, bin FROM op, range(68, 275) g(bin) WHERE n >= 4 AND rows >= 2 AND NOT EXISTS (SELECT 1 FROM used u WHERE u.doc_id = op.doc_id AND u.page = op.page AND u.bin = g.bin)),
ru AS (SELECT doc_id, page, low, high, bin - row_number() OVER (PARTITION BY doc_id, page ORDER BY bin) AS run, bin FROM free),
gap AS (SELECT doc_id, page, (max(bin) - min(bin) + 1) * 2 AS wide, floor((min(bin) + max(bin)) / 2 + 0.5) * 2 AS mid FROM ru GROUP BY doc_id, page, low, high, run HAVING low < mid AND high >= mid AND wide >= 6),
sd AS (SELECT g.doc_id, g.page, g.mid, v.x + v.w / 2 >= g.mid AS r, count(DISTINCT floor(v.y + 0.5)) AS rows, max(v.x + v.w) - min(v.x) AS reach FROM gap g JOIN wide v USING (doc_id, page) WHERE g.wide < 10 GROUP BY ALL),
bl AS (SELECT doc_id, page, mid FROM sd GROUP BY ALL HAVING count(*) = 2 AND min(rows) >= 20 AND min(reach) >= 171),
cuts AS (SELECT doc_id, page, min_by(mid, abs(mid - 342) * 10000 + mid)::DOUBLE AS cut FROM gap WHERE wide >= 10 OR EXISTS (SELECT 1 FROM bl WHERE bl.doc_id = gap.doc_id AND bl.page = gap.page AND bl.mid = gap.mid) GROUP BY ALL)"""


def wide_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two columns with gutters of 60, 12 and 9 points; page numbers below them, in every fourth document inside a long line."""
    k, f, long = F.col("seq") % 12, F.col("seq") % 97, F.col("doc_id") % 4 == 3
    shift = F.when(F.col("doc_id") % 3 == 0, 60.0).when(F.col("doc_id") % 3 == 1, 12.0).otherwise(9.0)
    x = F.when(f == 5, 330.0).when(f == 6, F.when(long, 200.0).otherwise(100.0)).when(f == 7, F.when(long, 345.0).otherwise(500.0)).otherwise(F.col("x") + F.when(k >= 6, shift).otherwise(0.0))
    w = F.when(f == 5, 8.0).when((f == 6) & long, 125.0).when(f.isin(6, 7), 20.0).otherwise(40.0)
    moved = items_of(spark, sf_dir).withColumns({"x": x, "w": w, "y": F.when(f.between(5, 7), 10.0).otherwise(F.col("y"))})
    return moved, derived.pages(spark, sf_dir).withColumn("page_width", F.lit(684.0))


@add(with_tables("items") + f", {_CUT} SELECT doc_id, page, cut FROM cuts")
def w6_column_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.column_cut(*wide_items(spark, sf_dir))


def _split_sql(depth: int = 3) -> str:
    """The levels of a recursive split, each over the parts of the one before."""
    out = ["w0 AS (SELECT doc_id, page, seq, y, x + CASE WHEN seq % 12 >= 9 THEN 120 WHEN seq % 12 >= 6 THEN 60 ELSE 0 END AS x, 40.0::DOUBLE AS w, '' AS path, 0.0::DOUBLE AS lo, 744.0::DOUBLE AS hi FROM items)"]
    for i in range(depth):
        out.append(f"""ok{i} AS (SELECT doc_id, page, path, min(x + 20) AS low, max(x + 20) AS high, min(lo) AS lo, min(hi) AS hi FROM w{i} GROUP BY ALL HAVING count(*) >= 4 AND count(DISTINCT floor(y + 0.5)) >= 2),
used{i} AS (SELECT DISTINCT doc_id, page, path, unnest(range(floor(x / 2)::INT, ceil((x + w) / 2)::INT + 1)) AS bin FROM w{i}),
grid{i} AS (SELECT *, unnest(range(floor((lo + 0.2::DOUBLE * (hi - lo)) / 2)::INT, ceil((lo + 0.8::DOUBLE * (hi - lo)) / 2)::INT + 1)) AS bin FROM ok{i}),
free{i} AS (SELECT g.*, bin - row_number() OVER (PARTITION BY doc_id, page, path ORDER BY bin) AS run FROM grid{i} g ANTI JOIN used{i} USING (doc_id, page, path, bin)),
runs{i} AS (SELECT doc_id, page, path, low, high, lo, hi, (max(bin) - min(bin) + 1) * 2 AS wide, (floor((min(bin) + max(bin)) / 2 + 0.5) * 2)::DOUBLE AS mid FROM free{i} GROUP BY doc_id, page, path, low, high, lo, hi, run),
cuts{i} AS (SELECT doc_id, page, path, min_by(mid, abs(mid - (lo + hi) / 2) * 10000 + mid)::DOUBLE AS cut FROM runs{i} WHERE wide >= least(10, 0.05::DOUBLE * (hi - lo)) AND low < mid AND high >= mid GROUP BY ALL),
w{i + 1} AS (SELECT doc_id, page, seq, y, x, w, path || CASE WHEN x + 20 >= cut THEN '1' ELSE '0' END AS path, CASE WHEN x + 20 >= cut THEN cut ELSE lo END AS lo, CASE WHEN x + 20 < cut THEN cut ELSE hi END AS hi FROM w{i} LEFT JOIN cuts{i} USING (doc_id, page, path))""")
    return ", ".join(out) + f" SELECT doc_id, page, seq, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY path) - 1)::INT AS col FROM w{depth}"


@add(with_tables("items") + f", {_split_sql()}")
def w7_split_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns a page: the right half of the first cut is cut again."""
    k = F.col("seq") % 12
    items = items_of(spark, sf_dir).withColumn("x", F.col("x") + F.when(k >= 9, 120.0).when(k >= 6, 60.0).otherwise(0.0)).withColumn("w", F.lit(40.0))
    return layout.split_columns(items.select("doc_id", "page", "seq", "x", "y", "w", "size"), derived.pages(spark, sf_dir).withColumn("page_width", F.lit(744.0))).select("doc_id", "page", "seq", "col")


_PLINES = """pl AS (SELECT doc_id, page, ord::INT AS line, ord % 20 AS k, size, CASE WHEN ord % 6 = 0 THEN '• ' ELSE '' END || 'x ' || text AS text, 72.0::DOUBLE AS x0, CASE WHEN ord % 10 = 9 THEN 272.0 ELSE 512.0 END::DOUBLE AS x1, ord % 8 = 6 AS split FROM paras),
yl AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN 780.0::DOUBLE - 12.0::DOUBLE * k WHEN 1 THEN 780.0::DOUBLE - 16.1::DOUBLE * k WHEN 2 THEN 780.0::DOUBLE - 39.0::DOUBLE * k ELSE 780.0::DOUBLE - 15.0::DOUBLE * k - 1.2::DOUBLE * (k // 3) END AS y FROM pl)"""


def led_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of four leadings by document: tight, wide, apart, and uneven; some are marked, short or split."""
    k = F.col("ord") % 20
    down = F.when(F.col("doc_id") % 4 == 0, 12.0 * k).when(F.col("doc_id") % 4 == 1, 16.1 * k).when(F.col("doc_id") % 4 == 2, 39.0 * k)
    y = F.when(F.col("doc_id") % 4 == 3, F.lit(780.0) - 15.0 * k - 1.2 * F.floor(k / 3)).otherwise(F.lit(780.0) - down)
    mark = F.when(F.col("ord") % 6 == 0, "• ").otherwise("")
    return derived.paragraphs(spark, sf_dir).select("doc_id", "page", F.col("ord").cast("int").alias("line"), y.alias("y"), "size", F.concat(mark, F.lit("x "), "text").alias("text"), F.lit(72.0).alias("x0"), F.when(F.col("ord") % 10 == 9, 272.0).otherwise(512.0).alias("x1"), (F.col("ord") % 8 == 6).alias("split"))


@add(with_tables("paras") + f""", {_PLINES}, g AS (SELECT *, lag(y) OVER w - y AS gap, greatest(size, lag(size) OVER w) AS big, coalesce(abs(size - lag(size) OVER w) < 1, false) AS same, lag(x1 - x0) OVER w AS above, lag(split) OVER w AS up_split, max(x1 - x0) OVER (PARTITION BY doc_id, page) AS measure FROM yl WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
u AS (SELECT doc_id, page, big, percentile_disc(0.5) WITHIN GROUP (ORDER BY gap) AS usual FROM g WHERE same AND gap > 0 AND gap <= 1.6::DOUBLE * big GROUP BY ALL HAVING count(*) >= 2),
c AS (SELECT g.*, usual, same AND usual IS NULL AND gap > 1.6::DOUBLE * g.big AND gap <= 1.75::DOUBLE * g.big AS wide FROM g LEFT JOIN u USING (doc_id, page, big)),
v AS (SELECT a.doc_id, a.page, a.big, min_by(b.gap, a.line) AS lead FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.page = a.page AND b.line = a.line - 1 AND a.wide AND b.wide AND a.big = b.big AND abs(a.gap - b.gap) <= 0.01::DOUBLE * b.gap GROUP BY ALL),
f AS (SELECT c.*, same AND (gap <= 1.6::DOUBLE * big OR (text NOT LIKE '• %' AND (gap <= 1.1::DOUBLE * usual OR (measure >= 0.3::DOUBLE * 612 AND abs(gap - lead) <= 0.02::DOUBLE * lead AND above >= 0.85::DOUBLE * measure AND NOT up_split AND NOT split)))) AS near FROM c LEFT JOIN v USING (doc_id, page, big))
SELECT doc_id, page, line, (sum(CASE WHEN coalesce(near, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line) - 1)::INT AS para FROM f""")
def w10_group_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = led_lines(spark, sf_dir)
    return layout.group_paragraphs(lines, lines.select("doc_id", "page", F.lit(612.0).alias("page_width")).distinct()).select("doc_id", "page", "line", "para")


@add(with_tables("items") + """, l AS (SELECT *, (seq % 600) // 12 AS r FROM items), s AS (SELECT *, lag(font) OVER w AS pf, lag(size) OVER w AS ps, lag(x + w) OVER w AS pe FROM l WINDOW w AS (PARTITION BY doc_id, page, r ORDER BY x, seq)),
t AS (SELECT *, CASE WHEN pe IS NOT NULL AND x - pe > 0.15 * least(size, ps) THEN ' ' ELSE '' END || str AS piece, CASE WHEN pf = font AND abs(size - ps) < 0.6 THEN 0 ELSE 1 END AS new FROM s),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, r ORDER BY x, seq) - 1 AS run FROM t)
SELECT doc_id, page, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY r) - 1)::INT AS line, run::INT AS run, text, font, size FROM (SELECT doc_id, page, r, run, string_agg(piece, '' ORDER BY x, seq) AS text, min(font) AS font, max(size) AS size FROM u GROUP BY ALL)""")
def w13_build_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.runs_of(layout.with_baselines(items_of(spark, sf_dir), ["x", "w", "size", "str", "font"]))


_STYLED = """wd AS (SELECT doc_id, page, seq, (seq % 600) // 36 AS para, (seq % 600) // 12 AS line, seq % 12 AS pos, x, y + CASE WHEN seq % 17 = 3 THEN 4 WHEN seq % 17 = 9 THEN -4 ELSE 0 END AS y, w, CASE WHEN seq % 17 IN (3, 9) THEN 6.0 ELSE 10.0 + 0.5 * (seq // 3 % 4) END::DOUBLE AS size, font, CASE WHEN seq % 23 < 2 THEN 'ff0000' END AS color, str FROM items),
st AS (SELECT *, max(size) OVER q AS big, lag(x + w) OVER p AS pe, lag(size) OVER p AS ps, lag(str) OVER p AS pstr, lead(line) OVER (PARTITION BY doc_id, page, para ORDER BY line, pos) AS next_line, row_number() OVER (PARTITION BY doc_id, page, para ORDER BY line, pos) AS rn FROM wd WINDOW q AS (PARTITION BY doc_id, page, line), p AS (PARTITION BY doc_id, page, line ORDER BY pos)),
bs AS (SELECT st.*, arg_min(CASE WHEN size = big THEN y END, CASE WHEN size = big THEN pos END) OVER (PARTITION BY doc_id, page, line) AS base FROM st),
pc AS (SELECT *, CASE WHEN size / big < 0.85 AND abs(y - base) > 0.12::DOUBLE * big THEN CASE WHEN y > base THEN 'super' ELSE 'sub' END END AS raised,
 CASE WHEN pe IS NOT NULL AND x - pe > 0.15::DOUBLE * least(size, ps) AND NOT regexp_matches(pstr, '\\s$') AND NOT regexp_matches(str, '^\\s') THEN ' ' ELSE '' END || str || CASE WHEN next_line <> line AND NOT regexp_matches(str, '\\s$') THEN ' ' ELSE '' END AS piece FROM bs)"""


def styled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of three rows: raised and lowered words, sizes that climb by half points, colours."""
    s = F.col("seq")
    items = items_of(spark, sf_dir)
    k = s % 600
    size = F.when((s % 17).isin(3, 9), 6.0).otherwise(10.0 + 0.5 * (F.floor(s / 3) % 4))
    y = F.col("y") + F.when(s % 17 == 3, 4.0).when(s % 17 == 9, -4.0).otherwise(0.0)
    return items.select("doc_id", "page", F.floor(k / 36).alias("para"), F.floor(k / 12).alias("line"), (s % 12).alias("pos"), "x", y.alias("y"), "w", size.alias("size"), "font", F.when(s % 23 < 2, "ff0000").alias("color"), "str")


@add("WITH RECURSIVE " + with_tables("items").removeprefix("WITH ") + f""", {_STYLED},
rc AS (SELECT doc_id, page, para, rn, size, raised, font, color, piece, 0 AS run, size AS head FROM pc WHERE rn = 1
UNION ALL SELECT p.doc_id, p.page, p.para, p.rn, p.size, p.raised, p.font, p.color, p.piece, r.run + CASE WHEN same THEN 0 ELSE 1 END, CASE WHEN same THEN r.head ELSE p.size END
 FROM rc r JOIN pc p ON p.doc_id = r.doc_id AND p.page = r.page AND p.para = r.para AND p.rn = r.rn + 1, LATERAL (SELECT p.font = r.font AND p.color IS NOT DISTINCT FROM r.color AND p.raised IS NOT DISTINCT FROM r.raised AND abs(p.size - r.head) < 0.6 AS same))
SELECT doc_id, page, para::BIGINT AS para, run::INT AS run, string_agg(piece, '' ORDER BY rn) AS text, any_value(head)::DOUBLE AS size, any_value(raised) AS raised, any_value(font) AS font, any_value(color) AS color FROM rc GROUP BY doc_id, page, para, run""")
def w13_paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.paragraph_runs(styled_words(spark, sf_dir))


@add(with_tables("paras") + """, o AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN page ELSE -1 - page END::INT AS page, ord, 'overlay ' || ord AS text, CASE WHEN ord % 4 = 1 THEN NULL ELSE y - 5 * (ord % 3) END AS y FROM paras),
a AS (SELECT doc_id, page, ord, text, y, 0 AS kind FROM paras UNION ALL SELECT *, 1 FROM o), k AS (SELECT *, CASE WHEN max(kind) OVER (PARTITION BY doc_id, page) > 0 THEN y END AS key FROM a)
SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY key DESC NULLS LAST, kind, ord) AS pos, text, y FROM k""")
def w20_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.paragraphs(spark, sf_dir)
    # the overlays of odd documents lie on pages of their own
    o = p.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("page")).otherwise(-1 - F.col("page")).cast("int").alias("page"), "ord", F.concat(F.lit("overlay "), "ord").alias("text"), F.when(F.col("ord") % 4 == 1, None).otherwise(F.col("y") - 5 * (F.col("ord") % 3)).alias("y"))
    return layout.interleave(p, o)


@add(with_tables("pages") + """, q AS (SELECT doc_id, page, list_sort(list(x)) AS xs, list_sort(list(x + w)) AS rs, list_sort(list(y + size)) AS ts, list_sort(list(y)) AS bs, count(*) AS n FROM items GROUP BY ALL),
p AS (SELECT doc_id, page, xs[floor(0.25 * (n - 1) + 0.5)::INT + 1] AS l, rs[floor(0.75 * (n - 1) + 0.5)::INT + 1] AS r, ts[floor(0.75 * (n - 1) + 0.5)::INT + 1] AS t, bs[floor(0.25 * (n - 1) + 0.5)::INT + 1] AS b FROM q)
SELECT doc_id, page, floor(greatest(0, least(l, 244.8)) + 0.5)::BIGINT AS margin_left, floor(greatest(0, least(612 - r, 244.8)) + 0.5)::BIGINT AS margin_right, floor(greatest(0, least(792 - t, 316.8)) + 0.5)::BIGINT AS margin_top, floor(greatest(0, least(b, 316.8)) + 0.5)::BIGINT AS margin_bottom FROM p""")
def a6_page_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    return layout.page_margins(items, derived.pages(spark, sf_dir))


_MARKS = ("• ", "► ", "- ", "– ", "(1. ", "a. ", "7. ", "8) ", "(9) ", "b) ", "(C) ", "iv) ", "(XII) ", "(xyz) ", " • ", "→x")
_MARKED = "mk AS (SELECT doc_id, ord, ord % 17 AS k, text FROM paras)"


@add(with_tables("paras") + f""", {_MARKED} SELECT doc_id, ord, CASE WHEN k IN (0, 1, 2) THEN 'bullet' WHEN k IN (6, 7, 8) THEN 'decimal' WHEN k = 9 THEN 'lower' WHEN k = 10 THEN 'upper' WHEN k = 11 THEN 'roman' WHEN k = 12 THEN 'upper_roman' END AS kind,
CASE k WHEN 6 THEN '7' WHEN 7 THEN '8' WHEN 8 THEN '9' WHEN 9 THEN 'b' WHEN 10 THEN 'C' WHEN 11 THEN 'iv' WHEN 12 THEN 'XII' END AS marker, CASE WHEN k = 6 THEN '%1.' WHEN k IN (7, 9, 11) THEN '%1)' WHEN k IN (8, 10, 12) THEN '(%1)' END AS form,
CASE WHEN k IN (0, 1, 2) OR k BETWEEN 6 AND 12 THEN 'x' || text END AS rest FROM mk""")
def f7_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("ord") % 17).cast("int")
    p = derived.paragraphs(spark, sf_dir).select("doc_id", "ord", F.concat(F.coalesce(F.get(F.array(*map(F.lit, _MARKS)), k), F.lit("")), F.lit("x"), "text").alias("text"))
    m = text.list_prefix(F.col("text"))
    return p.select("doc_id", "ord", *[m[c].alias(c) for c in ("kind", "marker", "form", "rest")])


@add(with_tables("items") + """, p AS (SELECT doc_id, seq, x, 792 - y AS y, (seq % 4 * 90)::INT AS r FROM items)
SELECT doc_id, seq, CASE r WHEN 90 THEN y WHEN 180 THEN 612 - x WHEN 270 THEN 612 - y ELSE x END AS cx, CASE r WHEN 90 THEN 792 - x WHEN 180 THEN 792 - y WHEN 270 THEN x ELSE y END AS cy, x AS bx, y AS "by" FROM p""")
def c7_reproject(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.lit(612.0), F.lit(792.0)
    p = items_of(spark, sf_dir).select("doc_id", "seq", "x", (792 - F.col("y")).alias("y"), (F.col("seq") % 4 * 90).alias("r"))
    cx, cy = geometry.to_content_point(F.col("x"), F.col("y"), w, h, F.col("r"))
    p = p.select("doc_id", "seq", "r", cx.alias("cx"), cy.alias("cy"))
    bx, by = geometry.to_display_point(F.col("cx"), F.col("cy"), w, h, F.col("r"))
    return p.select("doc_id", "seq", "cx", "cy", bx.alias("bx"), by.alias("by"))
