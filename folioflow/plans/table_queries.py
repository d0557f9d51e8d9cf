"""Registered queries of the table operators and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import layout, tables
from folioflow.sources import derived

from .base import Registry, with_tables
from .layout_queries import _NARROW, items_of, narrow_items

REGISTRY = Registry()
add = REGISTRY.add

_LATTICE = """v AS (SELECT DISTINCT doc_id, page, x AS p FROM rules WHERE h > w), hz AS (SELECT DISTINCT doc_id, page, y AS p FROM rules WHERE w > h),
vj AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id, page ORDER BY p) > 3 THEN 1 ELSE 0 END AS jump FROM v), vn AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id, page ORDER BY p) AS k FROM vj),
xs AS (SELECT doc_id, page, p0 AS lo, lead(p0) OVER (PARTITION BY doc_id, page ORDER BY p0) AS hi, row_number() OVER (PARTITION BY doc_id, page ORDER BY p0) - 1 AS c, count(*) OVER (PARTITION BY doc_id, page) AS n FROM (SELECT doc_id, page, k, avg(p) AS p0 FROM vn GROUP BY ALL)),
ys AS (SELECT doc_id, page, p AS lo, lead(p) OVER (PARTITION BY doc_id, page ORDER BY p) AS hi, row_number() OVER (PARTITION BY doc_id, page ORDER BY p DESC) - 2 AS r FROM hz),
cells AS (SELECT i.doc_id, i.page, ys.r, xs.c, string_agg(str, ' ' ORDER BY y DESC, x, seq) AS text FROM items i
 JOIN xs ON xs.doc_id = i.doc_id AND xs.page = i.page AND xs.hi IS NOT NULL AND x >= xs.lo AND (x < xs.hi OR (x = xs.hi AND xs.c = xs.n - 2))
 JOIN ys ON ys.doc_id = i.doc_id AND ys.page = i.page AND ys.hi IS NOT NULL AND y >= ys.lo AND (y < ys.hi OR (y = ys.hi AND ys.r = 0)) GROUP BY ALL),
lattice AS (SELECT doc_id, page, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY r) - 1)::INT AS r, (dense_rank() OVER (PARTITION BY doc_id, page ORDER BY c) - 1)::INT AS c, text FROM cells)"""


def lattice_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    return tables.lattice_tables(items, derived.rules(derived.pages(spark, sf_dir)))


@add(with_tables("rules") + f", {_LATTICE} SELECT * FROM lattice")
def w2_lattice_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_of(spark, sf_dir)


@add(with_tables("rules") + f", {_LATTICE} SELECT doc_id, page, r::INT AS r, c::INT AS c, text FROM cells")
def j9_assign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    return tables.assign_cells(items, tables.lattice_bounds(derived.rules(derived.pages(spark, sf_dir))))


@add(with_tables("items") + """, reg AS (SELECT DISTINCT doc_id, page, 112.0 AS x0, 400.0 AS y0, 312.0 AS x1, 650.0 AS y1 FROM items WHERE doc_id % 4 = 1)
SELECT doc_id, page, seq FROM items i WHERE NOT EXISTS (SELECT 1 FROM reg g WHERE g.doc_id = i.doc_id AND g.page = i.page AND i.x BETWEEN x0 AND x1 AND i.y BETWEEN y0 AND y1)""")
def j10_drop_in_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = items_of(spark, sf_dir)
    regions = derived.pages(spark, sf_dir).where("doc_id % 4 = 1").select("doc_id", "page", F.lit(112.0).alias("x0"), F.lit(400.0).alias("y0"), F.lit(312.0).alias("x1"), F.lit(650.0).alias("y1"))
    return tables.drop_in_regions(items, regions).select("doc_id", "page", "seq")


_BANDS = f"""{_NARROW}, rr AS (SELECT doc_id, page, x AS x1, max(x + w) OVER (PARTITION BY doc_id, page ORDER BY x, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x0 FROM narrow),
cuts AS (SELECT doc_id, page, (x0 + x1) / 2 AS mid FROM rr WHERE x1 - x0 >= 6),
lb AS (SELECT n.doc_id, n.page, n.y, n.seq, (SELECT count(*) FROM cuts c WHERE c.doc_id = n.doc_id AND c.page = n.page AND c.mid <= n.x) AS band FROM narrow n WHERE (doc_id, page) IN (SELECT (doc_id, page) FROM cuts)),
span AS (SELECT doc_id, page, count(*) AS n_lines, avg(CASE WHEN n >= 2 THEN 1.0 ELSE 0.0 END) AS ratio FROM (SELECT doc_id, page, y, count(DISTINCT band) AS n FROM lb GROUP BY ALL) GROUP BY ALL)"""


@add(with_tables("items") + f", {_BANDS} SELECT doc_id, page, n_lines, round(ratio, 6) AS ratio FROM span")
def a10_spanning_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tables.page_spans(narrow_items(spark, sf_dir)).select("doc_id", "page", "n_lines", "ratio")
    return out.withColumn("ratio", F.round("ratio", 6))


_BORDERLESS = f"""{_BANDS}, xs0 AS (SELECT doc_id, page, mid AS p FROM cuts UNION ALL SELECT doc_id, page, min(x) - 1 FROM narrow GROUP BY ALL UNION ALL SELECT doc_id, page, max(x + w) + 1 FROM narrow GROUP BY ALL),
xb AS (SELECT doc_id, page, p AS lo, lead(p) OVER q AS hi, row_number() OVER q - 1 AS c FROM xs0 WINDOW q AS (PARTITION BY doc_id, page ORDER BY p)),
base AS (SELECT DISTINCT doc_id, page, y FROM narrow), pit AS (SELECT doc_id, page, y, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS d FROM base),
half AS (SELECT doc_id, page, list_sort(list(d) FILTER (WHERE d IS NOT NULL))[count(d) // 2 + 1] / 2 AS h, min(y) AS y0, max(y) AS y1 FROM pit GROUP BY ALL HAVING count(*) >= 2),
ys0 AS (SELECT doc_id, page, y - d / 2 AS p FROM pit WHERE d IS NOT NULL UNION ALL SELECT doc_id, page, y0 - h FROM half UNION ALL SELECT doc_id, page, y1 + h FROM half),
yb AS (SELECT doc_id, page, p AS lo, lead(p) OVER q AS hi, row_number() OVER (PARTITION BY doc_id, page ORDER BY p DESC) - 2 AS r FROM ys0 WINDOW q AS (PARTITION BY doc_id, page ORDER BY p)),
bc AS (SELECT n.doc_id, n.page, yb.r::INT AS r, xb.c::INT AS c, string_agg(str, ' ' ORDER BY y DESC, x, seq) AS text FROM narrow n JOIN span s USING (doc_id, page) JOIN half USING (doc_id, page)
 JOIN xb ON xb.doc_id = n.doc_id AND xb.page = n.page AND x >= xb.lo AND x < xb.hi JOIN yb ON yb.doc_id = n.doc_id AND yb.page = n.page AND y >= yb.lo AND y < yb.hi WHERE n_lines >= 3 AND ratio >= 0.5 GROUP BY ALL),
dens AS (SELECT doc_id, page, list_sort(list(n))[count(*) // 2 + 1] AS density FROM (SELECT doc_id, page, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS n FROM bc) WHERE n > 0 GROUP BY ALL)"""


@add(with_tables("items") + f", {_BORDERLESS} SELECT bc.* FROM bc JOIN dens USING (doc_id, page) WHERE density <= 3")
def w5_borderless_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.borderless_tables(narrow_items(spark, sf_dir))


_ROWS = "lc AS (SELECT doc_id, page, r, c, text FROM (SELECT doc_id, page, (seq % 600 // 12)::INT AS r, (seq % 12 // 3)::INT AS c, string_agg(str, ' ' ORDER BY seq) AS text FROM items GROUP BY ALL))"


def row_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in threes as cells."""
    s = F.col("seq")
    c = items_of(spark, sf_dir).withColumns({"r": F.floor(s % 600 / 12).cast("int"), "c": F.floor(s % 12 / 3).cast("int")})
    return c.groupBy("doc_id", "page", "r", "c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "str"))), lambda x: x["str"]), " ").alias("text"))


@add(with_tables("items") + f", {_ROWS}, n AS (SELECT doc_id, page, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) AS n FROM lc) SELECT doc_id, page, list_sort(list(n))[count(*) // 2 + 1]::BIGINT AS density FROM n WHERE n > 0 GROUP BY ALL")
def a9_cell_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_density(row_cells(spark, sf_dir))


_GENRE = "gc AS (SELECT doc_id, page, r, c, CASE WHEN (doc_id + r + c) % 3 = 0 THEN text || ', ' || r WHEN r % 4 = 1 AND doc_id % 2 = 0 THEN text || ' ......' ELSE text END AS text FROM lc)"


@add(with_tables("items") + f""", {_ROWS}, {_GENRE}, g AS (SELECT doc_id, page, r, bool_or(regexp_matches(text, '\\.{{4,}}')) AS leader, count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]')) AS lettered,
 count(*) FILTER (WHERE regexp_matches(text, '[A-Za-z]') AND regexp_matches(text, '[A-Za-z].*[ ,]\\d{{1,4}}(?:\\s*[,-]\\s*\\d{{1,4}})*$')) AS entries FROM gc GROUP BY ALL)
SELECT doc_id, page, sum(lettered) > 0 AND sum(entries) >= 0.3 * sum(lettered) AS is_index, avg(CASE WHEN leader THEN 1.0 ELSE 0.0 END) >= 0.2 AS is_contents FROM g GROUP BY ALL""")
def a8_genre_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, r = F.col("text"), F.col("r")
    odd = F.when((F.col("doc_id") + r + F.col("c")) % 3 == 0, F.concat(t, F.lit(", "), r)).when((r % 4 == 1) & (F.col("doc_id") % 2 == 0), F.concat(t, F.lit(" ......"))).otherwise(t)
    return tables.genre_gate(row_cells(spark, sf_dir).withColumn("text", odd))


@add(with_tables("items") + f", {_ROWS}, k AS (SELECT * FROM lc WHERE (doc_id + r + c) % 3 > 0), w AS (SELECT doc_id, page, max(c) + 1 AS width FROM k GROUP BY ALL), rr AS (SELECT DISTINCT doc_id, page, r FROM k) SELECT rr.doc_id, rr.page, rr.r, g.c::INT AS c, coalesce(k.text, '') AS text FROM rr JOIN w USING (doc_id, page) JOIN range(4) g(c) ON g.c < w.width LEFT JOIN k ON k.doc_id = rr.doc_id AND k.page = rr.page AND k.r = rr.r AND k.c = g.c")
def a13_pad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pad_rows(row_cells(spark, sf_dir).where("(doc_id + r + c) % 3 > 0"))


_MERGES = "mc AS (SELECT l_orderkey // 4 AS t, l_orderkey % 4 AS r, l_linenumber AS cell, 1 + l_partkey % 2 AS span, CASE (l_suppkey + l_linenumber) % 4 WHEN 0 THEN 'restart' WHEN 1 THEN 'continue' WHEN 2 THEN 'continue' END AS merge, l_partkey::VARCHAR AS text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1)"


@add(f"""WITH {_MERGES}, a AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY t, r ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_col FROM mc),
o AS (SELECT *, last_value(CASE WHEN coalesce(merge, 'none') <> 'continue' THEN coalesce(merge, 'none') END IGNORE NULLS) OVER (PARTITION BY t, start_col ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opener FROM a),
j AS (SELECT *, coalesce(merge = 'continue' AND opener = 'restart', false) AS joins FROM o), h AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY t, start_col ORDER BY r) AS head FROM j)
SELECT t, start_col::BIGINT AS start_col, min(r) AS r, min_by(span, r) AS span, count(*) AS n_rows, min_by(text, r) AS text FROM h GROUP BY t, start_col, head""")
def w19_resolve_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    li = derived.table(spark, sf_dir, "lineitem")
    one = li.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey"))).where("k = 1")
    kind = (F.col("l_suppkey") + F.col("l_linenumber")) % 4
    cells = one.select(F.floor(F.col("l_orderkey") / 4).alias("t"), (F.col("l_orderkey") % 4).alias("r"), F.col("l_linenumber").alias("cell"), (1 + F.col("l_partkey") % 2).alias("span"), F.when(kind == 0, "restart").when(kind.isin(1, 2), "continue").alias("merge"), F.col("l_partkey").cast("string").alias("text"))
    return tables.resolve_merges(cells, ["t"])


_TYPED = "tc AS (SELECT l_orderkey AS id, l_linenumber AS k, CASE l_linenumber % 7 WHEN 0 THEN '00' || l_partkey WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN '-' || l_suppkey || '.50' WHEN 3 THEN '+' || l_partkey WHEN 4 THEN l_partkey || '.' WHEN 5 THEN l_partkey || 'e3' ELSE l_partkey || '.125' END AS text FROM lineitem)"


@add(f"WITH {_TYPED} SELECT id, k, text, CASE WHEN regexp_full_match(text, '-?(0|[1-9]\\d{{0,14}})') OR regexp_full_match(text, '-?(0|[1-9]\\d{{0,12}})\\.\\d{{1,2}}') OR regexp_full_match(text, '-?(0|[1-9]\\d{{0,8}})\\.\\d{{0,5}}[1-9]') THEN text::DOUBLE END AS num, CASE WHEN num IS NULL THEN text END AS txt FROM tc")
def k2_typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = derived.table(spark, sf_dir, "lineitem")
    n, p = F.col("l_linenumber") % 7, F.col("l_partkey")
    text = F.when(n == 0, F.concat(F.lit("00"), p)).when(n == 1, p.cast("string")).when(n == 2, F.concat(F.lit("-"), F.col("l_suppkey"), F.lit(".50"))).when(n == 3, F.concat(F.lit("+"), p)).when(n == 4, F.concat(p, F.lit("."))).when(n == 5, F.concat(p, F.lit("e3"))).otherwise(F.concat(p, F.lit(".125")))
    return tables.typed_cells(li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), text.alias("text")))


_CSV = "cc AS (SELECT doc_id, page, r, c, CASE WHEN (r + c) % 5 = 0 THEN '=' || text WHEN (r + c) % 5 = 1 THEN text || '\"' ELSE text END AS text FROM lc), q AS (SELECT doc_id, page, r, c, CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END AS t FROM cc)"


@add(with_tables("items") + f", {_ROWS}, {_CSV} SELECT doc_id, page, r, string_agg(CASE WHEN regexp_matches(t, '[\",\\r\\n]') THEN '\"' || replace(t, '\"', '\"\"') || '\"' ELSE t END, ',' ORDER BY c) AS line FROM q GROUP BY ALL")
def k1_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, t = (F.col("r") + F.col("c")) % 5, F.col("text")
    return tables.csv_rows(row_cells(spark, sf_dir).withColumn("text", F.when(k == 0, F.concat(F.lit("="), t)).when(k == 1, F.concat(t, F.lit('"'))).otherwise(t)))
