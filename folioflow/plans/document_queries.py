"""Registered queries of the document-level operators and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import text
from folioflow.operators import document, layout
from folioflow.sources import derived

from .base import Registry, with_tables
from .layout_queries import _LINES, items_of

REGISTRY = Registry()
add = REGISTRY.add

_BODY = "sz AS (SELECT doc_id, size, sum(length(text)) AS n, min(ord) AS first FROM paras GROUP BY ALL), body AS (SELECT doc_id, size AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM sz) WHERE k = 1)"
_LEVEL = f"{_BODY}, big AS (SELECT DISTINCT doc_id, size FROM paras JOIN body USING (doc_id) WHERE size >= 1.15 * body), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY size DESC) AS rank FROM big), lev AS (SELECT p.*, coalesce(CASE WHEN rank <= 6 THEN rank END, 0)::INT AS level FROM paras p LEFT JOIN rk USING (doc_id, size))"


@add(with_tables("paras") + f", {_BODY} SELECT * FROM body")
def a1_body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.body_size(derived.paragraphs(spark, sf_dir))


@add(with_tables("paras") + f", {_LEVEL} SELECT doc_id, ord, level FROM lev")
def a2_rank_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.paragraphs(spark, sf_dir)
    return document.rank_headings(p, document.body_size(p)).select("doc_id", "ord", "level")


@add(with_tables("paras") + f""", {_LEVEL}, up AS (SELECT * REPLACE (CASE WHEN ord % 4 = 2 THEN upper(replace(text, 'ß', 'ss')) ELSE text END AS text) FROM lev), top AS (SELECT doc_id, max(level) AS top FROM lev GROUP BY ALL)
SELECT doc_id, ord, CASE WHEN level = 0 AND abs(size / body - 1) <= 0.05 AND ord % 8 <> 5 AND ((text = upper(text) AND regexp_matches(text, '[A-Z]')) OR ord % 4 = 1) AND len(regexp_extract_all(text, '[A-Za-z]')) >= 3 AND len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) <= 8 THEN CASE WHEN top > 0 THEN least(6, top + 1) ELSE 3 END ELSE level END::INT AS level FROM up JOIN top USING (doc_id) JOIN body USING (doc_id)""")
def a3_promote_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.paragraphs(spark, sf_dir)
    body = document.body_size(p)
    ranked = document.rank_headings(p, body)
    shout = ranked.withColumn("text", F.when(F.col("ord") % 4 == 2, F.upper(F.replace("text", F.lit("ß"), F.lit("ss")))).otherwise(F.col("text")))
    shout = shout.withColumns({"bold": F.col("ord") % 4 == 1, "ruled": F.col("ord") % 8 == 5})
    return document.promote_headings(shout, body).select("doc_id", "ord", "level")


_BANDED = "bd AS (SELECT doc_id, n AS ord, (n // 4)::INT AS page, CASE WHEN n % 4 = 0 AND doc_id % 2 = 0 THEN 'Report ' || doc_id || ' page ' || (n // 4) WHEN n % 4 = 3 AND doc_id % 3 = 0 THEN '- ' || (n // 4) || ' -  Draft' ELSE text END AS text, (780 - 250 * (n % 4))::DOUBLE AS y, 792.0::DOUBLE AS page_height FROM (SELECT doc_id, ord AS n, text FROM paras))"
_RUNNING = f"""{_BANDED}, kd AS (SELECT *, CASE WHEN y >= 0.88 * page_height THEN 'header' WHEN y <= 0.12 * page_height THEN 'footer' END AS band, lower(trim(regexp_replace(regexp_replace(text, '[0-9]', '', 'g'), '\\s+', ' ', 'g'))) AS key FROM bd),
pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, band, page ORDER BY CASE WHEN band = 'header' THEN -y ELSE y END, ord) AS k FROM kd WHERE band IS NOT NULL AND key <> '') WHERE k = 1),
np AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM bd GROUP BY ALL HAVING n_pages >= 3),
vt AS (SELECT doc_id, band, key, count(*) AS n, min(page) AS first, min_by(text, page) AS text, n_pages FROM pp JOIN np USING (doc_id) GROUP BY doc_id, band, key, n_pages HAVING count(*) >= ceil(0.6 * n_pages - 1e-9)),
running AS (SELECT doc_id, band, key, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, band ORDER BY n DESC, first) AS k FROM vt) WHERE k = 1)"""


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, four a page, some documents with running headers or footers."""
    p = derived.paragraphs(spark, sf_dir)
    n, d = F.col("ord"), F.col("doc_id")
    page = F.floor(n / 4)
    body = F.when((n % 4 == 0) & (d % 2 == 0), F.concat(F.lit("Report "), d, F.lit(" page "), page)).when((n % 4 == 3) & (d % 3 == 0), F.concat(F.lit("- "), page, F.lit(" -  Draft"))).otherwise(F.col("text"))
    return p.select("doc_id", "ord", page.cast("int").alias("page"), body.alias("text"), (780.0 - 250 * (n % 4)).alias("y"), "page_height")


@add(with_tables("paras") + f", {_RUNNING} SELECT * FROM running")
def a4_running_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.running_bands(banded(spark, sf_dir))


@add(with_tables("paras") + f", {_RUNNING} SELECT doc_id, ord, text FROM kd WHERE NOT EXISTS (SELECT 1 FROM running r WHERE r.doc_id = kd.doc_id AND r.band = kd.band AND r.key = kd.key)")
def a5_drop_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = banded(spark, sf_dir)
    return document.drop_bands(p, document.running_bands(p)).select("doc_id", "ord", "text")


@add(with_tables("paras") + ", pr AS (SELECT doc_id, page, CASE WHEN ord % 3 = 0 THEN 'سلام دنیا و همه مردم جهان' ELSE text END AS text FROM paras), l AS (SELECT *, len(regexp_extract_all(text, '\\p{L}')) AS n, regexp_matches(text, '[\\x{0600}-\\x{06FF}]') AS ar FROM pr) SELECT doc_id, page, CASE WHEN sum(n) > 0 THEN coalesce(sum(n) FILTER (WHERE ar), 0) > coalesce(sum(n) FILTER (WHERE NOT ar), 0) END AS rtl FROM l GROUP BY ALL")
def a7_direction_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.paragraphs(spark, sf_dir).withColumn("text", F.when(F.col("ord") % 3 == 0, "سلام دنیا و همه مردم جهان").otherwise(F.col("text")))
    return document.direction_vote(p, ["doc_id", "page"])


_ORD = "kinds AS (SELECT *, CASE WHEN NOT regexp_matches(text, '^(• |[0-9]+\\. |\\([a-z]+\\) )') THEN NULL WHEN g = 0 THEN 'bullet' WHEN g = 1 THEN 'decimal' WHEN g = 2 THEN 'lower' WHEN g = 3 THEN 'roman' END AS kind FROM runs3), fl AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AND ord > 0 THEN 0 ELSE 1 END AS new FROM kinds), rn AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM fl)"
_RUNS3 = "runs3 AS (SELECT doc_id, ord, (ord // 3) % 5 AS g, CASE (ord // 3) % 5 WHEN 0 THEN '• ' WHEN 1 THEN ord || '. ' WHEN 2 THEN '(' || chr((97 + ord % 26)::INT) || ') ' WHEN 3 THEN '(iv) ' ELSE '' END || 'x' || text AS text FROM paras)"


def threes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with list marks that stay the same for three paragraphs."""
    n = F.col("ord")
    g = F.floor(n / 3) % 5
    mark = F.when(g == 0, F.lit("• ")).when(g == 1, F.concat(n, F.lit(". "))).when(g == 2, F.concat(F.lit("("), F.char(97 + (n % 26).cast("int")), F.lit(") "))).when(g == 3, F.lit("(iv) ")).otherwise("")
    return derived.paragraphs(spark, sf_dir).withColumn("text", F.concat(mark, F.lit("x"), "text"))


@add(with_tables("paras") + f", {_RUNS3}, {_ORD} SELECT doc_id, ord, kind, CASE WHEN kind <> 'bullet' THEN row_number() OVER (PARTITION BY doc_id, run ORDER BY ord)::INT END AS ordinal FROM rn")
def w11_list_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.list_ordinals(threes(spark, sf_dir)).select("doc_id", "ord", "kind", "ordinal")


@add(with_tables("paras") + """, tg AS (SELECT doc_id, page, min(ord) * 10 + k AS target, CASE WHEN k = 2 THEN NULL WHEN k = 3 THEN 100 ELSE 700 - 300 * k END::DOUBLE AS top FROM paras, range(4) t(k) GROUP BY doc_id, page, k),
j AS (SELECT t.*, p.ord, p.y FROM tg t JOIN paras p USING (doc_id, page) WHERE trim(p.text) <> ''),
h AS (SELECT doc_id, target, CASE WHEN max(top) IS NULL THEN min(ord) ELSE coalesce(arg_min(ord, [-y, ord]) FILTER (WHERE y <= top + 1), arg_min(ord, [y, ord])) END AS ord FROM j GROUP BY ALL),
u AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY min(target)) AS bookmark FROM h GROUP BY doc_id, ord)
SELECT doc_id, target, ord, bookmark::INT AS bookmark FROM h JOIN u USING (doc_id, ord)""")
def j11_resolve_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = derived.paragraphs(spark, sf_dir)
    k = F.col("k")
    # the last of five destinations on each page is on one that the document does not have
    counts = p.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    kinds = [("XYZ", [0.0, 700.0, 1.0]), ("FitH", [400.0]), ("FitB", [300.0]), ("FitR", [0.0, 0.0, 50.0, 100.0]), ("XYZ", [0.0, 500.0, 1.0])]
    kind = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(n).alias("kind"), F.array(*map(F.lit, a)).alias("args")) for i, (n, a) in enumerate(kinds)])
    dests = p.groupBy("doc_id", "page").agg(F.min("ord").alias("m")).select("*", F.inline(kind)).select("doc_id", F.when(k == 4, F.col("page") + 1_000_000).otherwise(F.col("page")).alias("page"), (F.col("m") * 10 + k).alias("target"), "kind", "args")
    return document.resolve_anchors(p, document.destinations(dests, counts)).select("doc_id", "target", "ord", "bookmark")


_TREE = "nodes AS (SELECT doc_id, ord AS node_id, CASE WHEN ord > 0 THEN (ord - 1) // 4 END AS parent_id, ord, CASE WHEN ord % 6 = 5 THEN ' ' ELSE text END AS title FROM paras)"


def outline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("ord")
    return derived.paragraphs(spark, sf_dir).select("doc_id", n.alias("node_id"), F.when(n > 0, F.floor((n - 1) / 4)).alias("parent_id"), "ord", F.when(n % 6 == 5, " ").otherwise(F.col("text")).alias("title"))


@add("WITH RECURSIVE " + with_tables("paras").removeprefix("WITH ") + f", {_TREE}, tree AS (SELECT doc_id, node_id, title, 1 AS level, lpad(ord::VARCHAR, 19, '0') AS path FROM nodes WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.node_id, n.title, t.level + 1, t.path || '.' || lpad(n.ord::VARCHAR, 19, '0') FROM nodes n JOIN tree t ON n.doc_id = t.doc_id AND n.parent_id = t.node_id) SELECT doc_id, node_id, title, level, path FROM tree WHERE trim(title) <> ''")
def w21_flatten_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.flatten_outline(outline_nodes(spark, sf_dir))


@add("WITH RECURSIVE " + with_tables("paras").removeprefix("WITH ") + f", {_TREE}, fn AS (SELECT doc_id, node_id, parent_id, 'f' || ord AS part, CASE WHEN ord % 3 > 0 THEN title END AS value FROM nodes), tree AS (SELECT doc_id, node_id, part AS name, value FROM fn WHERE parent_id IS NULL UNION ALL SELECT n.doc_id, n.node_id, t.name || '.' || n.part, n.value FROM fn n JOIN tree t ON n.doc_id = t.doc_id AND n.parent_id = t.node_id) SELECT doc_id, name, value FROM tree WHERE value IS NOT NULL")
def s3_flatten_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = outline_nodes(spark, sf_dir)
    return document.flatten_fields(n.select("doc_id", "node_id", "parent_id", F.concat(F.lit("f"), "ord").alias("part"), F.when(F.col("ord") % 3 > 0, F.col("title")).alias("value")))


_BLOCKS = """bl AS (SELECT doc_id, ord, page, text, CASE WHEN ord % 3 = 1 THEN '- ' ELSE '' END AS marker, (CASE WHEN ord % 3 = 1 THEN ord % 2 ELSE 0 END)::INT AS depth, (CASE WHEN ord % 7 = 0 THEN 1 + ord % 3 ELSE 0 END)::INT AS level FROM paras),
tb AS (SELECT doc_id, page, min(ord) AS ord, [[min_by(text, ord), 'n|' || page], [' a  b ', max(ord)::VARCHAR]] AS cells FROM paras WHERE page % 3 = 1 GROUP BY doc_id, page),
im AS (SELECT doc_id, page, min(ord) AS ord, md5(doc_id || '/' || page) AS data FROM paras WHERE page % 4 = 2 GROUP BY doc_id, page)"""


def blocks_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks of two runs each (a first word, the rest), a table on every third page and an image on every fourth."""
    n = F.col("ord")
    item = n % 3 == 1
    p = derived.paragraphs(spark, sf_dir)
    url = F.when(n % 11 == 3, F.concat(F.lit("https://example.com/("), n, F.lit(")"))).when(n % 11 == 4, "javascript:x")
    word = F.regexp_extract("text", "^([^ ]* *)", 1)
    rest = F.substring("text", F.char_length(word) + 1, F.char_length("text"))
    none = F.lit(None).cast("string")
    first = F.struct(word.alias("text"), (n % 5 == 2).alias("bold"), (n % 4 == 1).alias("italic"), none.alias("url"), F.when(n % 11 == 5, F.concat(F.lit("a"), n % 3)).alias("anchor"))
    second = F.struct(rest.alias("text"), (n % 10 == 2).alias("bold"), (n % 6 == 3).alias("italic"), url.alias("url"), none.alias("anchor"))
    blocks = p.select("doc_id", "ord", "page", "text", F.when(item, "- ").otherwise("").alias("marker"), F.when(item, n % 2).otherwise(0).cast("int").alias("depth"), F.when(n % 7 == 0, 1 + n % 3).otherwise(0).cast("int").alias("level"), F.when(n % 13 == 6, F.concat(F.lit("b"), n)).alias("bookmark"), F.array(first, second).alias("runs"))
    pages = p.groupBy("doc_id", "page").agg(F.min("ord").alias("ord"), F.min_by("text", "ord").alias("top"), F.max("ord").cast("string").alias("last"))
    cells = F.array(F.array("top", F.concat(F.lit("n|"), "page")), F.array(F.lit(" a  b "), F.col("last")))
    images = pages.where("page % 4 = 2").select("doc_id", "page", "ord", F.lit("image/png").alias("mime"), F.md5(F.concat_ws("/", "doc_id", "page")).alias("data"))
    return blocks, pages.where("page % 3 = 1").select("doc_id", "page", "ord", cells.alias("cells")), images


@add(with_tables("paras") + f""", {_BLOCKS}, al AS (SELECT doc_id, page, 0 AS kind, ord, repeat('  ', depth) || marker || text AS t FROM bl WHERE trim(text) <> ''
UNION ALL SELECT doc_id, page, 1, ord, array_to_string(list_transform(cells, lambda r: array_to_string(list_transform(r, lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g'))), chr(9))), chr(10)) FROM tb UNION ALL SELECT doc_id, page, 2, ord, '[image]' FROM im)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page, kind, ord) AS body FROM al GROUP BY ALL""")
def k3_render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, tables, images = blocks_of(spark, sf_dir)
    return document.render_text(blocks, tables=tables, images=images)


_STYLED = "CASE WHEN trim({t}) = '' THEN {t} ELSE regexp_extract({t}, '^( *)', 1) || {open} || {stars} || replace(replace(trim({t}), '\\', '\\\\'), '*', '\\*') || {stars} || {close} || regexp_extract({t}, '( *)$', 1) END"
_FIRST = _STYLED.format(t="w", stars="CASE WHEN ord % 5 = 2 THEN '**' ELSE '' END || CASE WHEN ord % 4 = 1 THEN '*' ELSE '' END", open="CASE WHEN ord % 11 = 5 THEN '[' ELSE '' END", close="CASE WHEN ord % 11 = 5 THEN '](#a' || ord % 3 || ')' ELSE '' END")
_SECOND = _STYLED.format(t="r", stars="CASE WHEN ord % 10 = 2 THEN '**' ELSE '' END || CASE WHEN ord % 6 = 3 THEN '*' ELSE '' END", open="CASE WHEN ord % 11 = 3 THEN '[' ELSE '' END", close="CASE WHEN ord % 11 = 3 THEN '](https://example.com/%28' || ord || '%29)' ELSE '' END")


@add(with_tables("paras") + f""", {_BLOCKS}, sp AS (SELECT *, regexp_extract(text, '^([^ ]* *)', 1) AS w FROM bl WHERE trim(text) <> ''), tw AS (SELECT *, substr(text, length(w) + 1) AS r FROM sp),
bo AS (SELECT *, {_FIRST} || {_SECOND} AS body FROM tw), an AS (SELECT * REPLACE (CASE WHEN ord % 13 = 6 THEN '<a id="b' || ord || '"></a>' || ltrim(body) ELSE body END AS body) FROM bo),
al AS (SELECT doc_id, page, 0 AS kind, ord, CASE WHEN marker <> '' THEN repeat('  ', depth) || marker || trim(body) WHEN level > 0 THEN repeat('#', level) || ' ' || trim(body) ELSE body END AS t FROM an
UNION ALL SELECT doc_id, page, 1, ord, '| ' || trim(replace(cells[1][1], '|', '\\|')) || ' | n\\|' || page || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a  b | ' || cells[2][2] || ' |' FROM tb UNION ALL SELECT doc_id, page, 2, ord, '![image](data:image/png;base64,' || data || ')' FROM im)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page, kind, ord) AS body FROM al GROUP BY ALL""")
def k4_render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, tables, images = blocks_of(spark, sf_dir)
    return document.render_markdown(blocks, tables=tables, images=images)


_FLAGS = {"has_script": "(?i)<script[\\s>]", "has_style": "(?i)<style[\\s>]", "has_comment": "<!--", "has_iframe": "(?i)<iframe[\\s>]", "has_form": "(?i)<form[\\s>]", "has_meta": "(?i)<meta[\\s>]", "has_link": "(?i)<link[\\s>]", "has_handler": "(?i)\\son[a-z]+\\s*=", "has_js_url": "(?i)javascript:", "has_data_url": "(?i)src\\s*=\\s*.data:", "has_object": "(?i)<(object|embed)[\\s>]"}


@add("SELECT *, " + " OR ".join(_FLAGS) + " AS any_artifact FROM (SELECT page_id, " + ", ".join(f"coalesce(regexp_matches(html, '{p}'), false) AS {n}" for n, p in _FLAGS.items()) + " FROM pages)")
def a11_artifact_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.artifact_census(derived.table(spark, sf_dir, "pages"))


@add("""WITH pl AS (SELECT l_partkey AS image, l_quantity AS a, l_linenumber AS b, l_tax * 100 AS c, l_quantity * 2 AS d FROM lineitem), im AS (SELECT p_partkey AS image, p_size * 10 AS px_w, p_size * 15 AS px_h FROM part),
s AS (SELECT image, max(sqrt(a * a + b * b)) AS w, max(sqrt(c * c + d * d)) AS h FROM pl GROUP BY ALL), f AS (SELECT *, 150 / least(px_w / (w / 72), px_h / (h / 72)) AS factor FROM im JOIN s USING (image) WHERE w > 0 AND h > 0)
SELECT image, greatest(1, floor(px_w * factor + 0.5))::BIGINT AS new_w, greatest(1, floor(px_h * factor + 0.5))::BIGINT AS new_h FROM f WHERE factor < 0.9""")
def a12_resample_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = derived.table(spark, sf_dir, "lineitem"), derived.table(spark, sf_dir, "part")
    placements = li.select(F.col("l_partkey").alias("image"), F.col("l_quantity").alias("a"), F.col("l_linenumber").alias("b"), (F.col("l_tax") * 100).alias("c"), (F.col("l_quantity") * 2).alias("d"))
    return document.resample_plan(placements, part.select(F.col("p_partkey").alias("image"), (F.col("p_size") * 10).alias("px_w"), (F.col("p_size") * 15).alias("px_h")))


_SHAPED = """sl AS (SELECT doc_id, page, ord % 20 AS k, ord % 20 // 3 AS para, ord AS line, size, CASE WHEN ord % 9 < 2 THEN '- ' ELSE '' END || 'x' || text AS text FROM paras),
sh AS (SELECT *, 780.0::DOUBLE - 12.5::DOUBLE * k - 40.0::DOUBLE * (para // 2) AS y, CASE WHEN para % 6 = 4 THEN 250 WHEN para % 6 = 5 THEN 400 WHEN k % 3 = 0 AND doc_id % 2 = 0 THEN 92 WHEN para % 6 = 1 THEN 110 ELSE 72 END::DOUBLE AS x0, CASE WHEN para % 6 = 4 THEN 362 WHEN k % 3 = 2 AND para % 6 < 4 THEN 300 ELSE 540 END::DOUBLE AS x1 FROM sl)"""


def shaped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of three lines: plain, inset, with indented first lines, centred, right, in uneven distances."""
    k = F.col("ord") % 20
    para = F.floor(k / 3)
    x0 = F.when(para % 6 == 4, 250.0).when(para % 6 == 5, 400.0).when((k % 3 == 0) & (F.col("doc_id") % 2 == 0), 92.0).when(para % 6 == 1, 110.0).otherwise(72.0)
    x1 = F.when(para % 6 == 4, 362.0).when((k % 3 == 2) & (para % 6 < 4), 300.0).otherwise(540.0)
    y = F.lit(780.0) - 12.5 * k - 40.0 * F.floor(para / 2)
    return derived.paragraphs(spark, sf_dir).select("doc_id", "page", para.alias("para"), F.col("ord").alias("line"), "size", F.concat(F.when(F.col("ord") % 9 < 2, "- ").otherwise(""), F.lit("x"), "text").alias("text"), y.alias("y"), x0.alias("x0"), x1.alias("x1"))


@add(with_tables("paras") + f""", {_SHAPED}, ed AS (SELECT doc_id, page, list_sort(list(x0))[floor(0.05::DOUBLE * (count(*) - 1) + 0.5)::INT + 1] AS c0, list_sort(list(x1))[floor(0.95::DOUBLE * (count(*) - 1) + 0.5)::INT + 1] AS c1 FROM sh GROUP BY ALL),
ln AS (SELECT sh.*, c0, c1, max(size) OVER q AS big, count(*) OVER q AS n, row_number() OVER (PARTITION BY doc_id, page, para ORDER BY line) AS i FROM sh JOIN ed USING (doc_id, page) WINDOW q AS (PARTITION BY doc_id, page, para)),
pg AS (SELECT doc_id, page, para, any_value(c0) AS c0, any_value(big) AS big, any_value(n) AS n, max(y) AS y, min(y) AS low, arg_min(x0, line) AS x0, min(CASE WHEN i > 1 OR n = 1 THEN x0 END) AS block, arg_min(text, line) AS text, greatest(2, any_value(big) / 2) AS tol,
 bool_and(abs((x0 + x1) / 2 - 306) < 30.6 AND x0 > 91.8 AND x1 - x0 < 367.2) AS mid, bool_and(x0 > 306) AND max(x1) - min(x1) < 12.24 AS rgt, any_value(n) >= 2 AND bool_and((i = n) OR (abs(x0 - c0) <= greatest(2, big / 2) AND abs(x1 - c1) <= greatest(2, big / 2))) AS jus FROM ln GROUP BY ALL),
al AS (SELECT *, CASE WHEN mid THEN 'center' WHEN rgt THEN 'right' WHEN jus THEN 'justify' ELSE 'left' END AS align, lag(low) OVER w - y - big AS up, low - lead(y) OVER w - big AS down FROM pg WINDOW w AS (PARTITION BY doc_id, page ORDER BY para))
SELECT doc_id, page, para::BIGINT AS para, align, CASE WHEN align IN ('left', 'justify') AND block - c0 > tol THEN floor(block - c0 + 0.5)::INT END AS indent_left, CASE WHEN align IN ('left', 'justify') AND x0 - block > tol THEN floor(x0 - block + 0.5)::INT END AS indent_first,
 CASE WHEN n > 1 AND (y - low) / (n - 1) BETWEEN 0.001 AND 4 * big THEN floor((y - low) / (n - 1) * 10 + 0.5) / 10 END::DOUBLE AS leading, CASE WHEN up > 0 THEN floor(least(up, 6 * big) + 0.5)::INT END AS space_before, CASE WHEN down > 0 THEN floor(least(down, 6 * big) + 0.5)::INT END AS space_after,
 CASE WHEN text LIKE '- %' THEN least(8, greatest(0, floor((x0 - c0) / big + 0.5)))::INT END AS list_depth, n::INT AS n_lines, x0, y, big AS size FROM al""")
def w14_paragraph_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = shaped_lines(spark, sf_dir)
    return document.paragraph_geometry(lines, lines.select("doc_id", "page", F.lit(612.0).alias("page_width")).distinct())


@add("WITH w AS (SELECT doc_id, text, string_split(replace(text, 'ß', 'ss'), ' ') AS t FROM documents) SELECT doc_id, array_to_string(list_transform(t, lambda x: upper(substr(x, 1, 1)) || substr(x, 2)), ' ') AS titled, len(regexp_extract_all(text, '\\p{L}')) AS letters FROM w")
def c3_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = derived.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.title_case(F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))).alias("titled"), text.letter_count(F.col("text")).cast("long").alias("letters"))


@add("WITH l AS (SELECT doc_id, unnest(range(len(t))) AS i, unnest(t) AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)), n AS (SELECT *, count(*) FILTER (WHERE s <> '') OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l) SELECT doc_id, string_agg(CASE WHEN s = '' THEN s ELSE k || '. ' || s END, chr(10) ORDER BY i) AS body FROM n GROUP BY ALL")
def c4_line_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.table(spark, sf_dir, "documents").select("doc_id", text.line_markers(F.col("text"), True).alias("body"))


@add("WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN ' ' || url || ' ' WHEN 1 THEN split_part(url, '://', 2) WHEN 2 THEN 'javascript:' || page_id WHEN 3 THEN 'mailto:a@example.com' ELSE chr(1) || 'ftp://x' END AS link FROM pages) SELECT page_id, CASE WHEN page_id % 5 = 0 THEN trim(link) WHEN page_id % 5 = 1 THEN 'https://' || link WHEN page_id % 5 = 3 THEN link END AS cleaned, page_id % 5 IN (0, 1, 3) AS allowed FROM u WHERE page_id % 5 < 4 UNION ALL SELECT page_id, NULL, false FROM u WHERE page_id % 5 = 4")
def f3_audit_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, url = F.col("page_id") % 5, F.col("url")
    link = F.when(k == 0, F.concat(F.lit(" "), url, F.lit(" "))).when(k == 1, F.element_at(F.split(url, "://"), 2)).when(k == 2, F.concat(F.lit("javascript:"), "page_id")).when(k == 3, "mailto:a@example.com").otherwise("\x01ftp://x")
    u = derived.table(spark, sf_dir, "pages").select("page_id", link.alias("link"))
    return u.select("page_id", text.clean_link(F.col("link")).alias("cleaned"), text.allowed_scheme(F.col("link")).alias("allowed"))


@add(with_tables("items") + " SELECT DISTINCT font, regexp_replace(font, '^[A-Z]{6}\\+', '') AS base, font LIKE '%Bold%' AS bold, false AS italic, 'serif' AS family FROM items")
def f10_font_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioflow.functions.fonts import font_style

    return font_style(items_of(spark, sf_dir).select("font").distinct())


@add("WITH c AS (SELECT l_orderkey AS id, l_linenumber AS k, l_discount * 10 AS r, l_tax * 10 AS g, l_discount + l_tax AS b FROM lineitem), v AS (SELECT id, k, lower(lpad(to_hex(floor(least(1.0, greatest(0.0, r)) * 255 + 0.5)::INT), 2, '0')) AS x, lower(lpad(to_hex(floor(least(1.0, greatest(0.0, g)) * 255 + 0.5)::INT), 2, '0')) AS y, lower(lpad(to_hex(floor(least(1.0, greatest(0.0, b)) * 255 + 0.5)::INT), 2, '0')) AS z FROM c) SELECT id, k, CASE WHEN k % 2 = 0 THEN x || x || x ELSE x || y || z END AS color FROM v")
def c11_hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = derived.table(spark, sf_dir, "lineitem")
    v = [F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_discount") + F.col("l_tax"), F.lit(0.0)]
    return li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("k"), text.hex_color(F.when(F.col("l_linenumber") % 2 == 0, "gray").otherwise("rgb"), v).alias("color"))
