"""Document-level passes over paragraphs: body size, headings, running bands, lists, links, trees and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.lineage import written
from folioflow.functions.text import ARABIC, allowed_scheme, encode_link, letters_of, list_prefix, roman

from .layout import PAGE


def body_size(paras: DataFrame) -> DataFrame:
    """doc_id, body: the size with the most characters; the one met first on a tie."""
    sizes = paras.groupBy("doc_id", "size").agg(F.sum(F.char_length("text")).alias("n"), F.min("ord").alias("first"))
    return sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def rank_headings(paras: DataFrame, body: DataFrame, *, least: float = 1.15, levels: int = 6) -> DataFrame:
    """Adds level: 1 to 6 by descending size over 1.15 body sizes, 0 else."""
    big = paras.join(body, "doc_id").where(F.col("size") >= least * F.col("body")).select("doc_id", "size").distinct()
    ranks = big.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))).where(F.col("rank") <= levels)
    return paras.join(ranks, ["doc_id", "size"], "left").withColumn("level", F.coalesce(F.col("rank"), F.lit(0)).cast("int")).drop("rank")


def promote_headings(paras: DataFrame, body: DataFrame) -> DataFrame:
    """Raises level where a short paragraph of about body size is all upper case or, by the column bold, in bold runs only: one under the last size level (6 at most), or 3 where there is none.

    Where there are columns for them, turned paragraphs and ones with a ruled run (underlined or struck) stay.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in paras.columns else F.lit(False)
    top = paras.groupBy("doc_id").agg(F.max("level").alias("top"))
    t = F.col("text")
    near = F.abs(F.col("size") / F.col("body") - 1) <= 0.05
    short = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) <= 8
    shout = (t == F.upper(t)) & t.rlike("[A-Z]")
    letters = F.regexp_count(t, F.lit("[A-Za-z]")) >= 3
    promoted = (F.col("level") == 0) & near & short & letters & (shout | flag("bold")) & ~flag("ruled") & ~flag("turned") & list_prefix(t).isNull()
    j = paras.join(top, "doc_id").join(body, "doc_id")
    return j.withColumn("level", F.when(promoted, F.when(F.col("top") > 0, F.least(F.lit(6), F.col("top") + 1)).otherwise(3)).otherwise(F.col("level"))).drop("top", "body")


def band_key(text: Column) -> Column:
    """What repeated headers share: no digits, single blanks, lower case (compatibility forms are folded beforehand where a text has any)."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "[0-9]", ""), r"\s+", " ")))


def running_bands(paras: DataFrame, *, band: float = 0.12, share: float = 0.6) -> DataFrame:
    """doc_id, band (header, footer), key, text: the outermost paragraphs that at least 60 % of three pages or more agree on."""
    y, h = F.col("y"), F.col("page_height")
    side = F.when(y >= (1 - band) * h, "header").when(y <= band * h, "footer")
    inside = paras.withColumn("band", side).withColumn("key", band_key(F.col("text"))).where("band IS NOT NULL AND key <> ''")
    outer = F.when(F.col("band") == "header", -y).otherwise(y)
    per_page = inside.groupBy("doc_id", "band", "page").agg(F.min_by(F.struct("key", "text"), F.struct(outer, "ord")).alias("m")).select("doc_id", "band", "page", "m.key", "m.text")
    pages = paras.groupBy("doc_id").agg(F.count_distinct("page").alias("n_pages")).where("n_pages >= 3")
    votes = per_page.groupBy("doc_id", "band", "key").agg(F.count("*").alias("n"), F.min("page").alias("first"), F.min_by("text", "page").alias("text")).join(pages, "doc_id").where(F.col("n") >= F.ceil(share * F.col("n_pages") - 1e-9))
    return votes.groupBy("doc_id", "band").agg(F.max_by(F.struct("key", "text"), F.struct("n", -F.col("first"))).alias("m")).select("doc_id", "band", "m.key", "m.text")


def drop_bands(paras: DataFrame, bands: DataFrame, *, band: float = 0.12) -> DataFrame:
    """Paragraphs that are not the running header or footer of their band."""
    y, h = F.col("y"), F.col("page_height")
    side = F.when(y >= (1 - band) * h, "header").when(y <= band * h, "footer")
    keyed = paras.withColumn("b_side", side).withColumn("b_key", band_key(F.col("text")))
    b = bands.select(F.col("doc_id").alias("b_doc"), F.col("band").alias("b_band"), F.col("key").alias("b_of"))
    return keyed.join(b, (F.col("doc_id") == F.col("b_doc")) & (F.col("b_side") == F.col("b_band")) & (F.col("b_key") == F.col("b_of")), "left_anti").drop("b_side", "b_key")


def direction_vote(df: DataFrame, keys: list[str], col: str = "text") -> DataFrame:
    """keys, rtl: more letters in right-to-left parts than in others; null without letters."""
    letters = F.regexp_count(F.col(col), F.lit(r"\p{L}"))
    right = F.sum(F.when(F.col(col).rlike(ARABIC), letters).otherwise(0))
    left = F.sum(F.when(F.col(col).rlike(ARABIC), 0).otherwise(letters))
    return df.groupBy(*keys).agg(right.alias("r"), left.alias("l")).select(*keys, F.when(F.col("r") + F.col("l") > 0, F.col("r") > F.col("l")).alias("rtl"))


def list_ordinals(paras: DataFrame) -> DataFrame:
    """Adds kind and ordinal: neighbours of one ordered kind count on, whatever stands between begins anew."""
    p = list_prefix(F.col("text"))
    marked = paras.withColumn("kind", p["kind"])
    w = Window.partitionBy("doc_id").orderBy("ord")
    new = F.when(F.col("kind").eqNullSafe(F.lag("kind").over(w)), 0).otherwise(1)
    run = marked.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy("doc_id", "run").orderBy("ord"))
    return run.withColumn("ordinal", F.when(F.col("kind").isNotNull() & (F.col("kind") != "bullet"), n)).drop("new", "run")


def list_marker(kind: Column, n: Column) -> Column:
    return F.when(kind == "bullet", "- ").when(kind == "decimal", F.concat(n, F.lit(". "))).when(kind == "lower", F.concat(letters_of(n), F.lit(". "))).when(kind == "upper", F.concat(F.upper(letters_of(n)), F.lit(". "))).when(kind == "roman", F.concat(roman(n), F.lit(". "))).when(kind == "upper_roman", F.concat(F.upper(roman(n)), F.lit(". "))).otherwise("")


def resolve_anchors(paras: DataFrame, targets: DataFrame) -> DataFrame:
    """target, doc_id, ord, bookmark: the highest paragraph at or under (by a point) a target's top, else the page's lowest; the first without a top. Equal paragraphs share a bookmark, numbered in the order of use."""
    p = paras.where(F.trim("text") != "").select("doc_id", "page", "ord", "y")
    j = targets.select("doc_id", "page", "target", "top").join(p, ["doc_id", "page"])
    below = F.col("y") <= F.col("top") + 1
    best = j.groupBy("doc_id", "target").agg(
        F.max_by("ord", F.when(below, F.struct(F.col("y"), -F.col("ord")))).alias("under"), F.min_by("ord", F.struct("y", "ord")).alias("lowest"), F.min("ord").alias("first"), F.max("top").alias("top")
    )
    hit = best.select("doc_id", "target", F.when(F.col("top").isNull(), F.col("first")).otherwise(F.coalesce("under", "lowest")).alias("ord"))
    used = hit.groupBy("doc_id", "ord").agg(F.min("target").alias("used"))
    named = used.withColumn("bookmark", F.row_number().over(Window.partitionBy("doc_id").orderBy("used")))
    return hit.join(named.select("doc_id", "ord", "bookmark"), ["doc_id", "ord"])


def destinations(dests: DataFrame, counts: DataFrame) -> DataFrame:
    """The links' destinations (doc_id, target, page from 0, kind, args) with their top: XYZ has it second, FitH and FitBH first, FitR fourth; others, and numbers that are not finite, have none. Pages that the document (n_pages) does not have go."""
    top = F.when(F.col("kind") == "XYZ", F.get("args", F.lit(1))).when(F.col("kind").isin("FitH", "FitBH"), F.get("args", F.lit(0))).when(F.col("kind") == "FitR", F.get("args", F.lit(3)))
    there = dests.join(counts.select("doc_id", "n_pages"), "doc_id").where((F.col("page") >= 0) & (F.col("page") < F.col("n_pages")))
    return there.withColumn("top", top).withColumn("top", F.when(F.abs("top") < float("inf"), F.col("top"))).drop("n_pages")


def by_level(roots: DataFrame, nodes: DataFrame, step: dict[str, Column]) -> DataFrame:
    """The roots and, level by level, the nodes under them: each level joins only the one above and is written to the checkpoint folder.

    ``step`` gives the columns of a node from its own and its parent's (up_...). Rows that no root leads to, cycles among them, are left out.
    """
    nodes = written(nodes.where("parent_id IS NOT NULL"))
    level = seen = written(roots)
    while not level.isEmpty():
        up = level.select([F.col(c).alias(f"up_{c}") for c in level.columns])
        level = written(nodes.join(up, (F.col("doc_id") == F.col("up_doc_id")) & (F.col("parent_id") == F.col("up_node_id"))).select("doc_id", "node_id", *[e.alias(c) for c, e in step.items()]))
        seen = seen.unionByName(level)
    return seen


def flatten_outline(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, level, title, path: a tree (node_id, parent_id, ord, title) in preorder by path; blank titles are left out, their children stay."""
    own = F.lpad(F.col("ord").cast("string"), 19, "0")  # as long as a long
    roots = nodes.where("parent_id IS NULL").select("doc_id", "node_id", "title", F.lit(1).alias("level"), own.alias("path"))
    tree = by_level(roots, nodes, {"title": F.col("title"), "level": F.col("up_level") + 1, "path": F.concat("up_path", F.lit("."), own)})
    return tree.where(F.trim("title") != "")


def flatten_fields(nodes: DataFrame) -> DataFrame:
    """doc_id, name, value: dotted names of nested fields (node_id, parent_id, part, value) that have a value."""
    roots = nodes.where("parent_id IS NULL").select("doc_id", "node_id", F.col("part").alias("name"), "value")
    tree = by_level(roots, nodes, {"name": F.concat_ws(".", "up_name", "part"), "value": F.col("value")})
    return tree.where("value IS NOT NULL").select("doc_id", "name", "value")


def _optional(df: DataFrame, name: str, kind: str) -> Column:
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)


def _whole_texts(parts: list[DataFrame]) -> DataFrame:
    """doc_id, body: pages one after the other, on each the paragraphs, then tables, then images, a blank line between."""
    both = parts[0].select("doc_id", "page", F.lit(0).alias("kind"), "ord", "t")
    for kind, part in enumerate(parts[1:], 1):
        both = both.unionByName(part.select("doc_id", "page", F.lit(kind).alias("kind"), "ord", "t"))
    rows = F.array_sort(F.collect_list(F.struct("page", "kind", "ord", "t")))
    return both.where(F.col("t").rlike(r"\S")).groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n\n").alias("body"))


def render_text(blocks: DataFrame, *, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """doc_id, body: blocks (ord, text, marker, depth) that are not blank, lists indented by two blanks a depth, a blank line between.

    Tables (doc_id, page, ord, cells) come as rows of cells parted by tabs and images (doc_id, page, ord) as a
    placeholder, both after the blocks of their page; the blocks then need a page.
    """
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), "marker", "text")
    parts = [blocks.where(F.col("text").rlike(r"\S")).select("doc_id", F.coalesce(_optional(blocks, "page", "long"), F.lit(0)).alias("page"), "ord", line.alias("t"))]
    if tables is not None:
        cell = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
        rows = F.transform("cells", lambda r: F.array_join(F.transform(r, cell), "\t"))
        parts.append(tables.select("doc_id", "page", "ord", F.array_join(rows, "\n").alias("t")))
    if images is not None:
        parts.append(images.select("doc_id", "page", "ord", F.lit("[image]").alias("t")))
    return _whole_texts(parts)


def markdown_run(r: Column) -> Column:
    """A run (text, bold, italic, url, anchor) as Markdown: stars and backslashes escaped, emphasis and links around the trimmed text; a link that is not allowed is plain, and so is a blank run."""
    t = r["text"]
    lead, tail = F.regexp_extract(t, r"^(\s*)", 1), F.regexp_extract(t, r"(\s*)$", 1)
    core = F.regexp_replace(F.regexp_replace(t, r"^\s+|\s+$", ""), r"([*\\])", r"\\$1")
    on = lambda c: F.coalesce(r[c], F.lit(False))
    stars = F.concat(F.when(on("bold"), "**").otherwise(""), F.when(on("italic"), "*").otherwise(""))
    strong = F.concat(stars, core, stars)
    outside = F.when(allowed_scheme(r["url"]), F.concat(F.lit("["), strong, F.lit("]("), encode_link(F.trim(r["url"])), F.lit(")"))).otherwise(strong)
    inside = F.when(r["anchor"].isNotNull(), F.concat(F.lit("["), strong, F.lit("](#"), r["anchor"], F.lit(")"))).otherwise(strong)
    linked = F.when(r["url"].isNotNull() & (r["url"] != ""), outside).otherwise(inside)
    return F.when(t.rlike(r"\S"), F.concat(lead, linked, tail)).otherwise(t)


def render_markdown(blocks: DataFrame, *, tables: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """doc_id, body: as text, with headings (a list item is none), runs, and an anchor before the text of a block with a bookmark.

    A block has runs (see :func:`markdown_run`), or is one run of its own columns text, bold, italic, url and anchor.
    Tables (cells) are pipe tables whose first row is the header, images (mime, data) data links.
    """
    b = blocks
    if "runs" not in blocks.columns:
        own = [F.col("text"), *[_optional(blocks, c, k).alias(c) for c, k in (("bold", "boolean"), ("italic", "boolean"), ("url", "string"), ("anchor", "string"))]]
        b = blocks.withColumn("runs", F.array(F.struct(*own)))
    body = F.array_join(F.transform("runs", markdown_run), "")
    mark = _optional(blocks, "bookmark", "string")
    body = F.when(mark.isNotNull(), F.concat(F.lit('<a id="'), mark, F.lit('"></a>'), F.regexp_replace(body, r"^\s+", ""))).otherwise(body)
    trimmed = F.regexp_replace(body, r"^\s+|\s+$", "")
    item = F.concat(F.repeat(F.lit("  "), F.col("depth")), "marker", trimmed)
    line = F.when(F.col("marker") != "", item).when(F.col("level") > 0, F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), trimmed)).otherwise(body)
    some = F.exists("runs", lambda r: r["text"].rlike(r"\S"))
    parts = [b.where(some).select("doc_id", F.coalesce(_optional(blocks, "page", "long"), F.lit(0)).alias("page"), "ord", line.alias("t"))]
    if tables is not None:
        cell = lambda c: F.trim(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))
        row = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        first = F.element_at("cells", 1)
        rows = F.transform("cells", lambda r: row(F.transform(r, cell)))
        rows = F.concat(F.slice(rows, 1, 1), F.array(row(F.transform(first, lambda _: F.lit("---")))), F.slice(rows, F.lit(2), F.size(rows)))
        held = tables.where((F.size("cells") > 0) & (F.size(F.get("cells", F.lit(0))) > 0))
        parts.append(held.select("doc_id", "page", "ord", F.array_join(rows, "\n").alias("t")))
    if images is not None:
        parts.append(images.select("doc_id", "page", "ord", F.concat(F.lit("![image](data:"), "mime", F.lit(";base64,"), "data", F.lit(")")).alias("t")))
    return _whole_texts(parts)


def artifact_census(pages: DataFrame, col: str = "html") -> DataFrame:
    """page_id and a flag for each kind of active or hidden artifact in a page."""
    h = F.col(col)
    flags = {
        "has_script": r"(?i)<script[\s>]", "has_style": r"(?i)<style[\s>]", "has_comment": "<!--", "has_iframe": r"(?i)<iframe[\s>]", "has_form": r"(?i)<form[\s>]", "has_meta": r"(?i)<meta[\s>]",
        "has_link": r"(?i)<link[\s>]", "has_handler": r"(?i)\son[a-z]+\s*=", "has_js_url": r"(?i)javascript:", "has_data_url": r"(?i)src\s*=\s*.data:", "has_object": r"(?i)<(object|embed)[\s>]",
    }
    out = pages.select("page_id", *[F.coalesce(h.rlike(p), F.lit(False)).alias(n) for n, p in flags.items()])
    total = F.lit(False)
    for n in flags:
        total = total | F.col(n)
    return out.withColumn("any_artifact", total)


def resample_plan(placements: DataFrame, images: DataFrame, *, dpi: float = 150.0) -> DataFrame:
    """image, new_w, new_h: images (px_w, px_h) whose largest placement (matrix a-d, points) has more than the target dots an inch by over a tenth."""
    size = placements.groupBy("image").agg(F.max(F.hypot("a", "b")).alias("pt_w"), F.max(F.hypot("c", "d")).alias("pt_h"))
    j = images.join(size, "image").where("pt_w > 0 AND pt_h > 0")
    factor = dpi / F.least(F.col("px_w") / (F.col("pt_w") / 72), F.col("px_h") / (F.col("pt_h") / 72))
    new = lambda c: F.greatest(F.lit(1), F.floor(F.col(c) * F.col("factor") + 0.5)).cast("long")
    return j.withColumn("factor", factor).where("factor < 0.9").select("image", new("px_w").alias("new_w"), new("px_h").alias("new_h"))


def paragraph_geometry(lines: DataFrame, pages: DataFrame, *, keys: list[str] = PAGE) -> DataFrame:
    """keys, para, align, indent_left, indent_first, leading, space_before, space_after, list_depth, n_lines, x0, y, size of paragraphs from their lines (para, line, y, size, x0, x1, text).

    The column's edges are the nearest-rank 5 % of its lines' left ends and 95 % of the right ones, and an edge counts
    as met within half the paragraph's largest size, two points at least. Lines in the middle of the page, inset and
    narrow, are centred; lines that start in its right half and end alike are right; two lines or more of which all
    but the last meet both edges are justified; all others are left. Left and justified ones have the indent of the
    lines after the first, and the first one's beyond it. Leading is the mean gap to a tenth; the spaces to the
    neighbours are what the size leaves of the gap, six sizes at most. A list item's depth counts sizes from the
    left edge. What does not apply or is too small to count is null.
    """
    rank = lambda c, p: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(p * (F.count(c) - 1) + 0.5) + 1).cast("int"))
    edges = lines.groupBy(*keys).agg(rank(F.col("x0"), 0.05).alias("c0"), rank(F.col("x1"), 0.95).alias("c1"))
    row = F.struct("line", "y", "x0", "x1", "size", "text")
    paras = lines.groupBy(*keys, "para").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(edges, keys).join(pages.select(*PAGE, "page_width"), PAGE)
    n, top, last, width = F.size("rows"), F.get("rows", F.lit(0)), F.element_at("rows", -1), F.col("page_width")
    big = F.array_max(F.transform("rows", lambda r: r["size"]))
    paras = paras.withColumns({"n_lines": n, "size": F.when(big > 0, big).otherwise(12.0), "x0": top["x0"], "y": top["y"], "low": last["y"]})
    tol = F.greatest(F.lit(2.0), 0.5 * F.col("size"))
    centred = F.forall("rows", lambda r: (F.abs((r["x0"] + r["x1"]) / 2 - width / 2) < 0.05 * width) & (r["x0"] > 0.15 * width) & (r["x1"] - r["x0"] < 0.6 * width))
    right = F.forall("rows", lambda r: (r["x0"] > 0.5 * width) & (F.abs(r["x1"] - top["x1"]) < 0.02 * width))
    body = F.slice("rows", F.lit(1), F.greatest(F.lit(1), n - 1))
    flush = (n >= 2) & F.forall(body, lambda r: (F.abs(r["x0"] - F.col("c0")) <= tol) & (F.abs(r["x1"] - F.col("c1")) <= tol))
    align = F.when(centred, "center").when(right, "right").when(flush, "justify").otherwise("left")
    rest = F.array_min(F.transform(F.when(n > 1, F.slice("rows", F.lit(2), n)).otherwise(F.col("rows")), lambda r: r["x0"]))
    whole = lambda c: F.floor(c + 0.5).cast("int")
    inset = F.col("align").isin("left", "justify")
    mean = F.try_divide(F.col("y") - F.col("low"), n - 1)
    order = Window.partitionBy(*keys).orderBy("para")
    space = lambda gap: F.when(gap > 0, whole(F.least(gap, 6 * F.col("size"))))
    depth = F.least(F.lit(8), F.greatest(F.lit(0), whole((F.col("x0") - F.col("c0")) / F.greatest("size", F.lit(1.0)))))
    return paras.withColumn("align", align).withColumn("block", rest).select(
        *keys, "para", "align",
        F.when(inset & (F.col("block") - F.col("c0") > tol), whole(F.col("block") - F.col("c0"))).alias("indent_left"),
        F.when(inset & (F.col("x0") - F.col("block") > tol), whole(F.col("x0") - F.col("block"))).alias("indent_first"),
        F.when((n >= 2) & (mean > 0) & (mean < 4 * F.col("size")), F.floor(mean * 10 + 0.5) / 10).alias("leading"),
        space(F.lag("low").over(order) - F.col("y") - F.col("size")).alias("space_before"),
        space(F.col("low") - F.lead("y").over(order) - F.col("size")).alias("space_after"),
        F.when(list_prefix(F.ltrim(top["text"])).isNotNull(), depth).alias("list_depth"),
        "n_lines", "x0", "y", "size",
    )
