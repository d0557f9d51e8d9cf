"""Words to lines, columns and paragraphs, page by page."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import fold_ligatures, is_arabic, list_prefix

PAGE = ["doc_id", "page"]


def items_from_raw(raw: DataFrame) -> DataFrame:
    """Items with text, their size (from the matrix, else the height, else 12) and box; ligatures are folded."""
    size = F.coalesce(F.expr("nullif(hypot(a, b), 0)"), F.expr("nullif(abs(height), 0)"), F.lit(12.0))
    kept = raw.where(F.col("str").rlike(r"\S"))
    return kept.select("*", size.alias("size"), F.col("e").alias("x"), F.col("f").alias("y"), F.abs("width").alias("w")).withColumn("str", fold_ligatures(F.col("str")))


def cluster_positions(df: DataFrame, keys: list[str], col: str, *, tol: float = 3.0) -> DataFrame:
    """keys, cluster (0, 1, ... upwards) and center: values whose gap to the one before is at most ``tol`` are one."""
    w = Window.partitionBy(*keys).orderBy(col)
    gap = F.when(F.col(col) - F.lag(col).over(w) > tol, 1).otherwise(0)
    marked = df.select(*keys, col).withColumn("jump", gap)
    numbered = marked.withColumn("cluster", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return numbered.groupBy(*keys, "cluster").agg(F.avg(col).alias("center"))


def split_rotated(items: DataFrame) -> DataFrame:
    """Adds turned (null, up, down) and stamp: the page's turned items are fewer than its upright ones."""
    turned = F.when(F.abs("b") > F.abs("a"), F.when(F.col("b") > 0, "up").otherwise("down"))
    w = Window.partitionBy(*PAGE)
    n_turned, n_all = F.count("turned").over(w), F.count(F.lit(1)).over(w)
    return items.withColumn("turned", turned).withColumn("stamp", F.col("turned").isNotNull() & (n_turned < n_all - n_turned))


def mark_rules(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds underline and strike: a thin, long rule that covers half of an item near its baseline or its middle."""
    i = items.select("*", F.col("x").alias("ix0"), (F.col("x") + F.col("w")).alias("ix1"))
    r = rules.select(F.col("doc_id").alias("r_doc"), F.col("page").alias("r_page"), F.col("x").alias("r_x"), F.col("y").alias("r_y"), F.col("w").alias("r_w"), F.col("h").alias("r_h")).where("r_w > 3 * r_h AND r_w > 2")
    cover = F.least(F.col("ix1"), F.col("r_x") + F.col("r_w")) - F.greatest("ix0", "r_x")
    dy = (F.col("r_y") + F.col("r_h") / 2 - F.col("y")) / F.col("size")
    near = (F.col("r_h") <= 0.18 * F.col("size")) & (cover >= 0.5 * F.col("w")) & dy.between(-0.35, 0.62)
    hits = i.join(r, (F.col("doc_id") == F.col("r_doc")) & (F.col("page") == F.col("r_page")) & near)
    kinds = hits.groupBy("doc_id", "page", "seq").agg(F.bool_or(dy.between(-0.35, 0.10)).alias("underline"), F.bool_or(dy.between(0.18, 0.62)).alias("strike"))
    out = items.join(kinds, [*PAGE, "seq"], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("underline", "strike")})


def tag_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """Adds url: of the first link whose box (edges included) holds the item's middle."""
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + 0.4 * F.col("size")
    l = links.select(F.col("doc_id").alias("l_doc"), F.col("page").alias("l_page"), "ord", "url", "lx", "ly", "lw", "lh")
    inside = cx.between(F.col("lx"), F.col("lx") + F.col("lw")) & cy.between(F.col("ly"), F.col("ly") + F.col("lh"))
    hits = items.join(l, (F.col("doc_id") == F.col("l_doc")) & (F.col("page") == F.col("l_page")) & inside)
    first = hits.groupBy("doc_id", "page", "seq").agg(F.min_by("url", "ord").alias("url"))
    return items.join(first, [*PAGE, "seq"], "left")


def split_at_links(items: DataFrame, links: DataFrame) -> DataFrame:
    """Items cut where a link's edge falls inside, at the character in proportion; pieces share the width.

    A left edge moves to the nearest start of a word, a right edge to the nearest end of one, by two characters at
    most, to the left on a tie; with none there it stays. Items that are turned (matrix a, b) or read from the
    right, and such of one character or no width, stay whole.
    """
    l = links.select(F.col("doc_id").alias("l_doc"), F.col("page").alias("l_page"), "lx", (F.col("lx") + F.col("lw")).alias("lx1"), "ly", "lh")
    l = l.select("*", F.explode(F.array(F.struct(F.col("lx").alias("edge"), F.lit(True).alias("opens")), F.struct(F.col("lx1").alias("edge"), F.lit(False).alias("opens")))).alias("e")).select("*", "e.edge", "e.opens")
    n, cy = F.char_length("str"), F.col("y") + 0.4 * F.col("size")
    right = F.col("x") + F.col("w")
    inside = (F.col("edge") > F.col("x")) & (F.col("edge") < right) & cy.between(F.col("ly"), F.col("ly") + F.col("lh"))
    level = ~is_arabic(F.col("str")) & (n >= 2) & (F.col("w") > 0)
    if {"a", "b"} <= set(items.columns):
        level = level & (F.abs("b") <= F.abs("a"))
    at = F.floor((F.col("edge") - F.col("x")) / F.col("w") * n + 0.5).cast("int")
    word = lambda k: F.substring(F.col("str"), k, F.lit(1)).rlike(r"[\p{L}\p{N}]")
    near = at
    for k in (2, -2, 1, -1, 0):
        before, after = word(at + k), word(at + k + 1)
        fits = (at + k > 0) & (at + k < n) & F.when(F.col("opens"), ~before & after).otherwise(before & ~after)
        near = F.when(fits, at + k).otherwise(near)
    hit = items.where(level).join(l, (F.col("doc_id") == F.col("l_doc")) & (F.col("page") == F.col("l_page")) & inside)
    cuts = hit.select("doc_id", "page", "seq", near.alias("cut")).groupBy("doc_id", "page", "seq").agg(F.array_sort(F.collect_set("cut")).alias("cuts"))
    joined = items.join(cuts, [*PAGE, "seq"], "left")
    # cuts are judged here and not before: as a filter on the pairs of item and edge they would be made for each pair
    starts = F.concat(F.array(F.lit(0)), F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: (c > 0) & (c < n)))
    parts = joined.select(*items.columns, F.posexplode(starts).alias("piece", "start"), starts.alias("starts"))
    stop = F.coalesce(F.get("starts", F.col("piece") + 1), n)
    return parts.withColumn("stop", stop).withColumn("x", F.col("x") + F.col("w") * F.col("start") / n).withColumn("w", F.col("w") * (F.col("stop") - F.col("start")) / n).withColumn("str", F.substring(F.col("str"), F.col("start") + 1, F.col("stop") - F.col("start"))).drop("starts", "start", "stop")


def join_colors(items: DataFrame, colors: DataFrame) -> DataFrame:
    """Adds color: of the last colour set at the item's rounded origin."""
    c = colors.select(F.col("doc_id").alias("c_doc"), F.col("page").alias("c_page"), F.floor(F.col("cx") + 0.5).alias("kx"), F.floor(F.col("cy") + 0.5).alias("ky"), "color", "ord").groupBy("c_doc", "c_page", "kx", "ky").agg(F.max_by("color", "ord").alias("color"))
    return items.join(c, (F.col("doc_id") == F.col("c_doc")) & (F.col("page") == F.col("c_page")) & (F.floor(F.col("x") + 0.5) == F.col("kx")) & (F.floor(F.col("y") + 0.5) == F.col("ky")), "left").drop("c_doc", "c_page", "kx", "ky")


def _page_rows(items: DataFrame, extra: list[str]) -> DataFrame:
    """doc_id, page and rows: a page's items from the top, left to right, as <down, x, seq, size and what else is wanted>."""
    row = F.struct((-F.col("y")).alias("down"), "x", "seq", "size", *[c for c in extra if c not in ("x", "seq", "size")])
    return items.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("rows"))


def _numbered(extra: list[str], line_of, rows: Column | str = "rows") -> Column:
    """The rows with line (line_of of a row); meant for the end of a fold, whose state stands for what is computed once a page."""
    return F.transform(rows, lambda r: F.struct(line_of(r).alias("line"), r["seq"].alias("seq"), (-r["down"]).alias("y"), *[r[c].alias(c) for c in extra if c not in ("seq", "y")]))


def baseline_rows(items: DataFrame, extra: list[str], *, tol: float | DataFrame | Callable[[Column], Column] = 3.0) -> DataFrame:
    """doc_id, page and rows, in the order of lines: line, seq, y and the columns ``extra``. From the top, an item joins the line whose first baseline is within ``tol`` of its own.

    An item's line depends on its baseline alone, so the fold runs over a page's distinct baselines. ``tol`` may be
    a table of the pages' own (tol), or what gives it from a page's rows.
    """
    zero = F.expr("named_struct('head', cast(null as double), 'downs', cast(array() as array<double>), 'lines', cast(array() as array<int>))")
    within = F.lit(tol) if isinstance(tol, int | float) else F.col("tol")

    def step(s: Column, down: Column) -> Column:
        same = F.coalesce(down - s["head"] <= within, F.lit(False))
        last = F.coalesce(F.try_element_at(s["lines"], F.lit(-1)), F.lit(-1))
        return F.struct(F.when(same, s["head"]).otherwise(down).alias("head"), F.concat(s["downs"], F.array(down)).alias("downs"), F.concat(s["lines"], F.array(F.when(same, last).otherwise(last + 1))).alias("lines"))

    downs = F.array_distinct(F.transform("rows", lambda r: r["down"]))
    made = F.aggregate(downs, zero, step, lambda s: _numbered(extra, lambda r: F.get(s["lines"], (F.array_position(s["downs"], r["down"]) - 1).cast("int"))))
    rows = _page_rows(items, extra)
    rows = rows.join(tol, PAGE) if isinstance(tol, DataFrame) else once(rows, tol=tol(F.col("rows"))) if callable(tol) else rows
    return rows.select(*PAGE, made.alias("rows"))


def with_baselines(items: DataFrame, extra: list[str], *, tol: float | DataFrame = 3.0) -> DataFrame:
    """doc_id, page, line, seq, y and the columns ``extra``; see :func:`baseline_rows`."""
    return baseline_rows(items, extra, tol=tol).select(*PAGE, F.inline("rows"))


def with_lines(items: DataFrame, extra: list[str]) -> DataFrame:
    """As :func:`with_baselines`, with tolerances in proportion to size and a reference that moves to the largest word.

    The fold keeps the numbers of the rows that start lines and nothing for each item; a line's rows are cut out whole.
    """
    zero = F.expr("named_struct('ref', cast(null as double), 'big', cast(0 as double), 'at', 0, 'starts', cast(array() as array<int>))")

    def step(s: Column, i: Column) -> Column:
        down = i["down"]
        small, gap = F.least(s["big"], i["size"]), F.abs(down - s["ref"])
        overlap = F.least(-s["ref"] + s["big"], -down + i["size"]) - F.greatest(-s["ref"], -down)
        close = (gap <= 0.5 * small) | ((small < 0.85 * F.greatest(s["big"], i["size"])) & (overlap > 0.3 * small))
        same = s["ref"].isNotNull() & F.coalesce(close, F.lit(False))
        larger = ~same | (i["size"] > s["big"])
        starts = F.when(same, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"])))
        return F.struct(F.when(larger, down).otherwise(s["ref"]).alias("ref"), F.when(larger, i["size"]).otherwise(s["big"]).alias("big"), (s["at"] + 1).alias("at"), starts.alias("starts"))

    def parted(s: Column) -> Column:
        own = lambda a, k: F.slice("rows", a + 1, F.coalesce(F.get(s["starts"], k + 1), F.size("rows")) - a)
        return F.flatten(F.transform(s["starts"], lambda a, k: _numbered(extra, lambda r: k, own(a, k))))

    return _page_rows(items, extra).select(*PAGE, F.inline(F.aggregate("rows", zero, step, parted)))


def cluster_baselines(items: DataFrame, *, tol: float = 3.0) -> DataFrame:
    """doc_id, page, line, seq: see :func:`with_baselines`."""
    return with_baselines(items, [], tol=tol).select(*PAGE, "line", "seq")


def cluster_lines(items: DataFrame) -> DataFrame:
    """doc_id, page, line, seq: see :func:`with_lines`."""
    return with_lines(items, []).select(*PAGE, "line", "seq")


def joined_lines(lined: DataFrame) -> DataFrame:
    """doc_id, page, line, y, size, x0, x1, text of items that have their line (x, w, size, seq, str): words from left to right, joined by a space."""
    words = F.sort_array(F.collect_list(F.struct("x", "seq", "str")))
    return lined.groupBy(*PAGE, "line").agg(F.max("y").alias("y"), F.max("size").alias("size"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.array_join(F.transform(words, lambda i: i["str"]), " ").alias("text"))


LINE_COLUMNS = ["x", "w", "size", "str"]


def baseline_texts(items: DataFrame) -> DataFrame:
    """The lines of :func:`with_baselines`, read once."""
    return joined_lines(with_baselines(items, LINE_COLUMNS))


def line_texts(items: DataFrame, lines: DataFrame) -> DataFrame:
    """As :func:`joined_lines`, with the items' lines in a table of their own."""
    return joined_lines(items.join(lines, [*PAGE, "seq"]))


def whitespace_bands(items: DataFrame, *, least: float = 6.0) -> DataFrame:
    """doc_id, page, x0, x1: gaps over the whole page between the furthest right edge so far and the next left edge."""
    w = Window.partitionBy(*PAGE).orderBy("x", "seq").rowsBetween(Window.unboundedPreceding, -1)
    reach = items.select(*PAGE, F.col("x").alias("x1"), F.max(F.col("x") + F.col("w")).over(w).alias("x0"))
    return reach.where(F.col("x1") - F.col("x0") >= least).select(*PAGE, "x0", "x1")


#: Column cuts, in points: bins, gutters that are always one and that are one between two blocks, and what parts words of a run.
BIN, GUTTER, NARROW_GUTTER, RUN_GAP = 2.0, 10.0, 6.0, 10.0
#: Shares: of the text's height that is the footer, of the page's width that a page number stays below, and that a run or a block reaches; rows of a block.
FOOTER, FOLIO, BLOCK, BLOCK_ROWS = 0.05, 0.04, 0.25, 20


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: inside of a fold over the row's words the optimiser would put what they stand for, and compute it for each word."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _regions(items: DataFrame, pages: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """keys, page_width, lo, hi, foot (null if items have none) and words: a region's items as <x, y, w, size and what else is wanted>.

    Words are gathered once: cuts are found, and regions parted, inside of a row, so that no item is written, shuffled or joined again.
    """
    held = items.join(pages.select(*PAGE, "page_width"), PAGE)
    bound = {"lo": F.min("lo") if "lo" in items.columns else F.lit(0.0), "hi": F.max("hi") if "hi" in items.columns else F.first("page_width"), "foot": F.max("foot") if "foot" in items.columns else F.lit(None).cast("double")}
    size = F.col("size") if "size" in items.columns else F.lit(0.0).alias("size")
    word = F.struct("x", "y", "w", size, *[c for c in extra if c not in ("x", "y", "w", "size", *keys)])
    return held.groupBy(*keys).agg(F.collect_list(word).alias("words"), F.first("page_width").alias("page_width"), *[c.alias(name) for name, c in bound.items()])


def _run_of(w: Column) -> Column:
    """Width of the run of a word: words (from left to right) of about its baseline of which no two neighbours are further apart than ``RUN_GAP``."""
    near = F.filter("__low", lambda o: F.abs(o["y"] - w["y"]) <= w["tol"])
    zero = F.struct(w["x"].alias("lo"), F.lit(float("-inf")).alias("hi"), F.lit(False).alias("done"))

    def step(s: Column, o: Column) -> Column:
        # one that is too far ends a run, for good if it is the word's own
        joins = o["x"] <= s["hi"] + RUN_GAP
        own = (s["lo"] <= w["x"]) & (s["hi"] >= w["x1"])
        ends = s["done"] | (~joins & own)
        lo = F.when(ends | joins, s["lo"]).otherwise(o["x"])
        hi = F.when(ends, s["hi"]).when(joins, F.greatest(s["hi"], o["x1"])).otherwise(o["x1"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), ends.alias("done"))

    return F.aggregate(near, zero, step, lambda s: s["hi"] - s["lo"])


def _gaps(last_bin: Column, first: Column, last: Column) -> Column:
    """<g0, g1>: the free runs of bins from ``first`` to ``last`` between the furthest bin so far and the next first one, and beyond the last."""
    gap = "array<struct<g0:bigint,g1:bigint>>"
    zero = F.expr(f"named_struct('reach', cast(null as bigint), 'gaps', cast(array() as {gap}))")
    free = lambda g0, g1: F.struct(F.greatest(g0, first).alias("g0"), F.least(g1, last).alias("g1"))

    def step(s: Column, b: Column) -> Column:
        # before the first word nothing is reached: greatest passes over it
        found = F.greatest(s["reach"] + 1, first) <= F.least(b["b0"] - 1, last)
        return F.struct(F.greatest(s["reach"], b["b1"]).alias("reach"), F.when(found, F.concat(s["gaps"], F.array(free(s["reach"] + 1, b["b0"] - 1)))).otherwise(s["gaps"]).alias("gaps"))

    ended = lambda s: F.when(s["reach"] + 1 <= last, F.concat(s["gaps"], F.array(free(s["reach"] + 1, last)))).otherwise(s["gaps"])
    bins = F.transform("__closing", lambda v: F.struct(F.greatest(F.lit(0).cast("long"), F.floor(v["x"] / BIN)).alias("b0"), F.least(F.ceil((v["x"] + v["w"]) / BIN), last_bin).alias("b1")))
    return F.aggregate(F.sort_array(bins), zero, step, ended)


def _with_cut(regions: DataFrame) -> DataFrame:
    """Adds cut (null without one) to what :func:`_regions` gives; see :func:`column_cut`. A region that is done, as it had no cut before, is not looked at again."""
    regions = regions if "done" in regions.columns else regions.withColumn("done", F.lit(False))
    row, middle = (lambda v: F.floor(v["y"] + 0.5)), (lambda v: v["x"] + v["w"] / 2)
    each = lambda f, of="__words": F.transform(of, f)
    ys, rows, mids = each(lambda v: v["y"]), each(row), each(middle)
    narrow = lambda v: v["w"] < FOLIO * F.col("page_width")
    reach = lambda v: F.greatest(F.lit(4.0), 0.45 * v["size"])
    foot = F.coalesce("foot", F.array_min(ys) + FOOTER * (F.array_max(ys) - F.array_min(ys)))
    held = once(regions, __words=F.when(F.col("done"), F.slice("words", 1, 0)).otherwise(F.col("words")))
    held = once(held, __foot=foot, __most=F.array_max(each(reach)), __whole=(F.size("__words") >= 4) & (F.array_min(rows) < F.array_max(rows)), __least=F.array_min(mids), __last=F.array_max(mids))
    held = once(held, __above=each(row, F.filter("__words", lambda v: v["y"] > F.col("__foot"))))
    # the footer's words are the lowest of a page: a run is looked for among them, not among all
    low = F.filter("__words", lambda v: v["y"] <= F.col("__foot") + F.col("__most"))
    low = each(lambda v: F.struct(v["x"].alias("x"), (v["x"] + v["w"]).alias("x1"), v["y"].alias("y"), reach(v).alias("tol"), (narrow(v) & (v["y"] <= F.col("__foot"))).alias("small")), low)
    opened = F.col("__whole") & F.coalesce(F.array_min("__above") < F.array_max("__above"), F.lit(False))
    held = once(held, __low=F.when(opened, F.sort_array(low)).otherwise(F.filter(low, lambda v: F.lit(False))))
    folios = F.filter("__low", lambda w: w["small"] & (_run_of(w) < BLOCK * F.col("page_width")))
    held = once(held, __folios=each(lambda w: F.struct(w["x"].alias("x"), w["y"].alias("y"), w["x1"].alias("x1")), folios))
    folio = lambda v: F.coalesce(narrow(v) & F.array_contains(F.col("__folios"), F.struct(v["x"].alias("x"), v["y"].alias("y"), (v["x"] + v["w"]).alias("x1"))), F.lit(False))
    region = F.col("hi") - F.col("lo")
    held = once(
        held, __closing=F.when(F.size("__folios") == 0, F.col("__words")).otherwise(F.filter("__words", lambda v: ~folio(v))), __bins=F.ceil(F.col("page_width") / BIN) - 1,
        __first=F.floor((F.col("lo") + 0.2 * region) / BIN), __until=F.ceil((F.col("lo") + 0.8 * region) / BIN), __gutter=F.least(0.05 * region, F.lit(GUTTER)), __region=region,
    )
    held = once(held, __gaps=F.when(F.col("__whole") & (F.size("__closing") > 0), _gaps(F.col("__bins"), F.col("__first"), F.col("__until"))))
    wide = each(lambda g: F.struct(((g["g1"] - g["g0"] + 1) * BIN).alias("wide"), (F.floor((g["g0"] + g["g1"]) / 2 + 0.5) * BIN).alias("mid")), "__gaps")
    held = once(held, __wide=F.filter(wide, lambda g: (F.col("__least") < g["mid"]) & (F.col("__last") >= g["mid"]) & (g["wide"] >= F.least("__gutter", F.lit(NARROW_GUTTER)))))

    def block(side: Column) -> Column:
        reached = F.array_max(each(lambda v: v["x"] + v["w"], side)) - F.array_min(each(lambda v: v["x"], side))
        return (F.size(F.array_distinct(each(row, side))) >= BLOCK_ROWS) & (reached >= BLOCK * F.col("__region"))

    # both sides of the narrow ones: they are few
    blocks = lambda g: block(F.filter("__words", lambda v: middle(v) >= g["mid"])) & block(F.filter("__words", lambda v: middle(v) < g["mid"]))
    good = F.filter("__wide", lambda g: (g["wide"] >= F.col("__gutter")) | F.coalesce(blocks(g), F.lit(False)))
    nearest = F.array_min(each(lambda g: F.struct(F.abs(g["mid"] - (F.col("lo") + F.col("hi")) / 2).alias("off"), g["mid"].alias("mid")), good))
    return once(held, cut=nearest["mid"]).select(*regions.columns, "cut")


def column_cut(items: DataFrame, pages: DataFrame, *, keys: list[str] = PAGE) -> DataFrame:
    """keys, cut: the middle of the gutter nearest to the middle of the region, in its inner 20-80 %.

    Words are laid on bins of two points; a free run of bins with words on both sides is a gutter if it is ten points
    wide (5 % of a narrow region), or six between two blocks, each of 20 rows and a quarter of the region's width.
    Of equally near gutters the left one is cut. Narrow words in the footer, such as page numbers, do not close a
    gutter, unless they belong to a run of words that is a quarter of the page wide. Fewer than four words or two
    rows have no cut. ``keys`` may part a page further; items then have the bounds lo and hi of their region, and
    may have foot, the top of the page's footer, which the region's own 5 % replaces else.
    """
    return _with_cut(_regions(items, pages, keys, [])).where("cut IS NOT NULL").select(*keys, "cut")


def _split(regions: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """keys, page_width, lo, hi, foot, words and col of the columns of regions; each half of a cut is cut again by its own bounds."""
    out = regions.withColumns({"path": F.lit(""), "done": F.lit(False)})
    for _ in range(depth):
        right = lambda v: F.coalesce(v["x"] + v["w"] / 2 >= F.col("cut"), F.lit(False))
        part = lambda side, lo, hi, words: F.struct(F.concat("path", F.lit(side)).alias("path"), F.col("cut").isNull().alias("done"), F.col(lo).alias("lo"), F.col(hi).alias("hi"), words.alias("words"))
        halves = F.array(part("0", "lo", "cut", F.filter("words", lambda v: ~right(v))), part("1", "cut", "hi", F.filter("words", right)))
        out = _with_cut(out).select(*keys, "page_width", "foot", F.inline(F.when(F.col("cut").isNotNull(), halves).otherwise(F.array(part("0", "lo", "hi", F.col("words"))))))
    return out.withColumn("col", (F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1).cast("int")).drop("path", "done")


def split_columns(items: DataFrame, pages: DataFrame, *, depth: int = 3, keys: list[str] = PAGE) -> DataFrame:
    """Adds col (0, 1, ... from left to right): each half of a cut is cut again by its own bounds, ``depth`` times at most."""
    regions = _regions(items.drop("lo", "hi"), pages, keys, items.columns)
    return _split(regions, keys, depth).select(*keys, "col", F.inline("words")).select(*items.columns, "col")


def split_slabs(items: DataFrame, pages: DataFrame, *, least_words: int = 8, least_lines: int = 6, span: float = 0.18) -> DataFrame:
    """Adds slab (0, 1, ... from the top) and col: pages that have no column cut are parted by white bands of 1.5 median sizes, and each slab is cut into columns.

    A slab's columns count if each has ``least_lines`` lines whose median spans ``span`` of the page, and less
    than half of its words are numbers; other slabs stay whole, and neighbours that stay whole are one.
    """
    page, slab = Window.partitionBy(*PAGE), [*PAGE, "slab"]
    whole = _split(_regions(items, pages, PAGE, items.columns), PAGE, 3)
    whole = whole.withColumn("open", (F.count("*").over(page) == 1) & (F.size("words") >= least_words))
    split = whole.where("NOT open").select(*PAGE, F.lit(0).alias("slab"), "col", F.inline("words"))
    # from the top; the fold keeps the numbers of the words that start a slab
    down = F.sort_array(F.transform("words", lambda v: F.struct((-v["y"]).alias("down"), v["x"].alias("x"), v["seq"].alias("seq"), v.alias("word"))))
    sizes = F.sort_array(F.filter(F.transform("words", lambda v: v["size"]), lambda v: v.isNotNull()))
    held = once(whole.where("open").select(*PAGE, "page_width", "foot", down.alias("rows"), sizes.alias("sizes")), usual=F.get("sizes", F.ceil(0.5 * F.size("sizes")).cast("int") - 1))
    zero = F.expr("named_struct('low', cast(null as double), 'at', 0, 'starts', cast(array() as array<int>))")

    def step(s: Column, r: Column) -> Column:
        jump = (s["at"] == 0) | F.coalesce(s["low"] - (r["word"]["y"] + r["word"]["size"]) >= 1.5 * F.col("usual"), F.lit(False))
        return F.struct(F.least(s["low"], r["word"]["y"]).alias("low"), (s["at"] + 1).alias("at"), F.when(jump, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"]).alias("starts"))

    held = once(held, starts=F.aggregate("rows", zero, step, lambda s: s["starts"]))
    own = F.slice("rows", F.col("at") + 1, F.coalesce(F.get("starts", F.col("slab") + 1), F.size("rows")) - F.col("at"))
    slabs = held.select("*", F.posexplode("starts").alias("slab", "at")).select(*slab, "page_width", "foot", F.transform(own, lambda r: r["word"]).alias("words"), F.lit(0.0).alias("lo"), F.col("page_width").alias("hi"))
    cut = _split(slabs, slab, 3).select(*slab, "page_width", "col", F.inline("words"))
    # lines carry their words, so that none is joined
    line = cut.groupBy(*slab, "page_width", "col", F.floor(F.col("y") + 0.5).alias("row")).agg((F.max(F.col("x") + F.col("w")) - F.min("x")).alias("reach"), F.count("*").alias("n"), F.count_if(F.col("str").rlike(r"^[\d.,%$€£+-]*\d[\d.,%$€£+-]*$")).alias("numbers"), F.collect_list(F.struct(*[c for c in items.columns if c not in PAGE])).alias("words"))
    columns = line.groupBy(*slab, "page_width", "col").agg(F.count("*").alias("rows"), F.expr("percentile_disc(0.5) within group (order by reach)").alias("reach"), (F.sum("numbers") < 0.5 * F.sum("n")).alias("prose"), F.flatten(F.collect_list("words")).alias("words"))
    fits = (F.col("rows") >= least_lines) & (F.col("reach") >= span * F.col("page_width")) & F.col("prose")
    states = columns.groupBy(*slab).agg((F.every(fits) & (F.count("*") > 1)).alias("good"), F.collect_list(F.struct("col", "words")).alias("columns"))
    # slabs that stay whole are one with such a neighbour
    by_slab = page.orderBy("slab")
    starts = states.withColumn("start", F.when(F.col("good") | F.coalesce(F.lag("good").over(by_slab), F.lit(True)), 1).otherwise(0))
    merged = starts.withColumn("slab", (F.sum("start").over(by_slab.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    parted = merged.select(*slab, "good", F.inline("columns")).select(*slab, F.when(F.col("good"), F.col("col")).otherwise(0).alias("col"), F.inline("words"))
    return split.select(*items.columns, "slab", "col").unionByName(parted.select(*items.columns, "slab", "col"))


def line_shapes(lined: DataFrame) -> DataFrame:
    """As :func:`joined_lines`, with size (of the longest word), and split: whether two neighbouring words are more than a size apart, as in a row of a table."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    gaps = lined.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(w))
    words = F.sort_array(F.collect_list(F.struct("x", "seq", "str")))
    size = F.max_by("size", F.struct(F.char_length("str"), -F.col("x")))
    held = gaps.groupBy(*PAGE, "line").agg(F.max("y").alias("y"), size.alias("size"), F.min("x").alias("x0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max("gap").alias("gap"), F.array_join(F.transform(words, lambda i: i["str"]), " ").alias("text"))
    return held.withColumn("split", F.coalesce(F.col("gap") > F.col("size"), F.lit(False))).drop("gap")


#: Gaps between lines, as multiples of their size: a wrapped line's at most, and one's of a page set wide.
WRAP, WIDE_WRAP = 1.6, 1.75


def group_paragraphs(lines: DataFrame, pages: DataFrame | None = None, *, keys: list[str] = PAGE) -> DataFrame:
    """Adds para to lines (line, y, size, text, x0, x1 and split) of a page or column.

    Neighbours whose sizes differ by less than 1 stay together if their gap is at most 1.6 sizes; if it is within a
    tenth of what is usual for the size; or if it is the wide leading of the size and the upper line fills the
    measure. The last two need a lower line without a list mark. What is usual is the lower median of a size's
    gaps up to 1.6 sizes, where there are two of them, and sizes are told apart to half a point. Only a size
    without such gaps has a wide leading: the first gap of up to 1.75 sizes that the next gap repeats to a
    hundredth. A gap is of that leading to two hundredths; the line above must reach 85 % of the widest line, that
    30 % of the page, and neither line may be split. Without ``pages`` (page_width) there is no wide leading.
    """
    w = Window.partitionBy(*keys).orderBy("line")
    up = lambda c: F.lag(c).over(w)
    size = F.greatest("size", up("size"))
    g = lines.withColumn("__gap", up("y") - F.col("y")).withColumn("__size", size).withColumn("__same", F.abs(F.col("size") - up("size")) < 1)
    g = g.withColumn("__half", F.floor(F.col("__size") * 2 + 0.5)).withColumn("__measure", F.max(F.col("x1") - F.col("x0")).over(Window.partitionBy(*keys)))
    one = Window.partitionBy(*keys, "__half")
    wrap = F.col("__same") & (F.col("__gap") > 0) & (F.col("__gap") <= WRAP * F.col("__size"))
    # nth of the sorted samples: the lower median
    samples = F.sort_array(F.collect_list(F.when(wrap, F.col("__gap"))).over(one))
    g = g.withColumn("__usual", F.when(F.size(samples) >= 2, F.get(samples, F.floor((F.size(samples) - 1) / 2).cast("int"))))
    wide = F.col("__same") & (F.col("__gap") > WRAP * F.col("__size")) & (F.col("__gap") <= WIDE_WRAP * F.col("__size")) & F.col("__usual").isNull()
    g = g.withColumn("__wide", F.when(wide, F.col("__gap")))
    repeated = F.col("__wide").isNotNull() & (up("__half") == F.col("__half")) & (F.abs(F.col("__wide") - up("__wide")) <= 0.01 * up("__wide"))
    g = g.withColumn("__found", F.when(repeated, F.struct("line", up("__wide").alias("gap"))))
    leading = F.min("__found").over(one)["gap"]
    width = F.lit(None).cast("double")
    if pages is not None:
        g = g.join(pages.select(*PAGE, F.col("page_width").alias("__width")), PAGE, "left")
        width = F.col("__width")
    marked = list_prefix(F.col("text")).isNotNull()
    held = (F.col("__measure") >= 0.3 * width) & (F.abs(F.col("__gap") - leading) <= 0.02 * leading) & (up("x1") - up("x0") >= 0.85 * F.col("__measure")) & ~up("split") & ~F.col("split")
    near = (F.col("__gap") <= WRAP * F.col("__size")) | (~marked & ((F.col("__gap") <= 1.1 * F.col("__usual")) | held))
    new = F.when(F.coalesce(F.col("__same") & near, F.lit(False)), 0).otherwise(1)
    flagged = g.withColumn("__new", new)
    return flagged.withColumn("para", (F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).select(*lines.columns, "para")


def build_runs(items: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, page, line, run, text, font, size: neighbours of one font whose sizes differ by less than 0.6; a space where the gap is over 0.15 sizes."""
    return runs_of(items.join(lines, [*PAGE, "seq"]))


def runs_of(j: DataFrame) -> DataFrame:
    """As :func:`build_runs`, of items that have their line."""
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    lead = F.when((gap > 0.15 * F.least("size", F.lag("size").over(w))) & ~F.lag("str").over(w).endswith(" ") & ~F.col("str").startswith(" "), " ").otherwise("")
    new = F.when((F.lag("font").over(w) == F.col("font")) & (F.abs(F.col("size") - F.lag("size").over(w)) < 0.6), 0).otherwise(1)
    runs = j.withColumn("piece", F.concat(lead, "str")).withColumn("new", new).withColumn("run", (F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return runs.groupBy(*PAGE, "line", "run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "seq", "piece"))), lambda p: p["piece"]), "").alias("text"), F.first("font").alias("font"), F.max("size").alias("size"))


#: Attributes of a word that its run shares, besides the size, and what stands for one that the words do not have.
STYLE = {"font": "string", "bold": "boolean", "italic": "boolean", "rtl": "boolean", "color": "string", "url": "string", "anchor": "string", "underline": "boolean", "strike": "boolean"}


def paragraph_runs(words: DataFrame, *, keys: list[str] = PAGE) -> DataFrame:
    """keys, para, run, text, size, raised and the columns of :data:`STYLE` that the words have: runs of a paragraph's words (para, line, pos in reading order, x, y, w, size, str).

    A word is raised (``super`` or ``sub``) if it is smaller than 0.85 of its line's largest and off its baseline by
    more than 0.12 of it. A word joins the run before it, on the same line or not, if they share all attributes and
    its size, to half a point, is within 0.6 of the run's first one. A blank comes between words whose boxes are over
    0.15 sizes apart, if neither has one there; where the direction changes, between the boxes of all words of a
    direction; and between lines.
    """
    style = [c for c in STYLE if c in words.columns]
    line, para = [*keys, "para", "line"], [*keys, "para"]
    rtl = F.col("rtl") if "rtl" in words.columns else F.lit(False)
    of_line, by_pos = Window.partitionBy(*line), Window.partitionBy(*line).orderBy("pos")
    up = lambda c: F.lag(c).over(by_pos)
    big = F.max("size").over(of_line)
    held = words.withColumns({"__big": big, "__x1": F.col("x") + F.col("w"), "__turn": F.when(rtl == F.lag(rtl).over(by_pos), 0).otherwise(1)})
    held = held.withColumn("__base", F.min(F.when(F.col("size") == F.col("__big"), F.struct("pos", "y"))).over(of_line)["y"])
    off, sizes = F.col("y") - F.col("__base"), F.col("size") / F.col("__big")
    held = held.withColumn("raised", F.when((sizes < 0.85) & (F.abs(off) > 0.12 * F.col("__big")), F.when(off > 0, "super").otherwise("sub")))
    held = held.withColumn("__part", F.sum("__turn").over(by_pos.rowsBetween(Window.unboundedPreceding, 0)))
    part = Window.partitionBy(*line, "__part")
    held = held.withColumns({"__p0": F.min("x").over(part), "__p1": F.max("__x1").over(part)})
    near, far = F.greatest("x", up("x")) - F.least("__x1", up("__x1")), F.greatest("__p0", up("__p0")) - F.least("__p1", up("__p1"))
    gap = F.when(F.col("__turn") == 1, far).otherwise(near)
    blank = (gap > 0.15 * F.least("size", up("size"))) & ~up("str").rlike(r"\s$") & ~F.col("str").rlike(r"^\s")
    order = Window.partitionBy(*para).orderBy("line", "pos")
    ends = (F.lead("line").over(order) != F.col("line")) & ~F.col("str").rlike(r"\s$")
    held = held.withColumn("__piece", F.concat(F.when(F.coalesce(blank, F.lit(False)), " ").otherwise(""), "str", F.when(F.coalesce(ends, F.lit(False)), " ").otherwise("")))
    held = held.withColumn("__half", F.floor(F.col("size") * 2 + 0.5) / 2).withColumn("__style", F.struct("raised", *style))
    new = F.when(F.col("__style").eqNullSafe(F.lag("__style").over(order)), 0).otherwise(1)
    held = held.withColumn("__new", new).withColumn("__alike", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # words of one style; only where their sizes differ a fold finds the first word of each run
    alike = held.groupBy(*para, "__alike").agg(F.sort_array(F.collect_list(F.struct("line", "pos", F.col("__half").alias("size"), F.col("__piece").alias("piece")))).alias("__words"), F.first("__style").alias("__style"))
    zero = F.expr("named_struct('head', cast(null as double), 'at', 0, 'starts', cast(array() as array<int>))")

    def step(s: Column, w: Column) -> Column:
        joins = F.coalesce(F.abs(w["size"] - s["head"]) < 0.6, F.lit(False))
        return F.struct(F.when(joins, s["head"]).otherwise(w["size"]).alias("head"), (s["at"] + 1).alias("at"), F.when(joins, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["at"]))).alias("starts"))

    sizes = F.transform("__words", lambda w: w["size"])
    starts = F.when(F.array_max(sizes) - F.array_min(sizes) < 0.6, F.array(F.lit(0))).otherwise(F.aggregate("__words", zero, step, lambda s: s["starts"]))
    cut = alike.withColumn("__starts", starts).select(*para, "__alike", "__style", "__words", "__starts", F.posexplode("__starts").alias("__no", "__at"))
    stop = F.coalesce(F.get("__starts", F.col("__no") + 1), F.size("__words"))
    own = F.slice("__words", F.col("__at") + 1, stop - F.col("__at"))
    runs = cut.withColumn("text", F.array_join(F.transform(own, lambda w: w["piece"]), "")).withColumn("size", F.get("__words", F.col("__at"))["size"])
    number = F.row_number().over(Window.partitionBy(*para).orderBy("__alike", "__no")) - 1
    return runs.select(*para, number.alias("run"), "text", "size", *[F.col(f"__style.{c}").alias(c) for c in ("raised", *style)])


def interleave(source: DataFrame, overlay: DataFrame) -> DataFrame:
    """doc_id, page, pos, text, y: both tables from the top down, no y last, the source first on ties; pages without overlay keep their order."""
    rows = source.select(*PAGE, "ord", "text", "y", F.lit(0).alias("kind")).unionByName(overlay.select(*PAGE, "ord", "text", "y", F.lit(1).alias("kind")))
    any_overlay = F.max("kind").over(Window.partitionBy(*PAGE)) > 0
    keyed = rows.withColumn("down", F.when(any_overlay, -F.col("y")))
    w = Window.partitionBy(*PAGE).orderBy(F.col("down").asc_nulls_last(), "kind", "ord")
    return keyed.select(*PAGE, F.row_number().over(w).cast("long").alias("pos"), "text", "y")


def page_margins(items: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page and the rounded margins: nearest-rank quartiles of the items' edges, within 0 and 40 % of the page."""
    pick = lambda c, p: F.element_at(F.sort_array(F.collect_list(c)), (F.floor(p * (F.count(c) - 1) + 0.5) + 1).cast("int"))
    q = items.groupBy(*PAGE).agg(pick(F.col("x"), 0.25).alias("l"), pick(F.col("x") + F.col("w"), 0.75).alias("r"), pick(F.col("y") + F.col("size"), 0.75).alias("t"), pick(F.col("y"), 0.25).alias("b")).join(pages, PAGE)
    held = lambda v, whole: F.floor(F.greatest(F.lit(0.0), F.least(v, 0.4 * whole)) + 0.5).cast("long")
    pw, ph = F.col("page_width"), F.col("page_height")
    return q.select(*PAGE, held(F.col("l"), pw).alias("margin_left"), held(pw - F.col("r"), pw).alias("margin_right"), held(ph - F.col("t"), ph).alias("margin_top"), held(F.col("b"), ph).alias("margin_bottom"))
