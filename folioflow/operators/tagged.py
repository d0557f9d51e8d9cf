"""Marked content, mixed directions, list continuations and logical lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.bidi import normalized_all
from folioflow.functions.text import is_arabic, letter_count

from .document import by_level
from .layout import LINE_COLUMNS, PAGE, baseline_rows, once
from .search import PAGE_CAP, arabic_query, match_offsets, pattern_of, search_items, search_normalized


def tagged_items(tokens: DataFrame) -> DataFrame:
    """doc_id, page, seq, leaf_id of items inside markers: tokens (seq, kind begin, end or item, leaf_id) of a page in order; markers without an id are seen through, items outside of any are left out."""
    w = Window.partitionBy(*PAGE).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    begin, end = F.col("kind") == "begin", F.col("kind") == "end"
    depth = F.sum(F.when(begin, 1).when(end, -1).otherwise(0)).over(w)
    level = tokens.withColumn("level", depth + end.cast("int"))
    same = Window.partitionBy(*PAGE, "level").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(begin, F.col("leaf_id").isNotNull()), ignorenulls=True).over(same)
    named = level.withColumn("named", F.when(begin, F.col("leaf_id").isNotNull()).when(end, opened).otherwise(False))
    inner = F.sum(F.when(begin & F.col("named"), 1).when(end & F.col("named"), -1).otherwise(0)).over(w)
    at = named.withColumn("inner", inner)
    last_id = F.last(F.when(begin & F.col("named"), F.col("leaf_id")), ignorenulls=True).over(Window.partitionBy(*PAGE, "inner").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("leaf", last_id).where("kind = 'item' AND inner > 0").select(*PAGE, "seq", F.col("leaf").alias("leaf_id"))


def merge_continuations(paras: DataFrame, *, indent: float = 2.0) -> DataFrame:
    """Adds head: the list item that a paragraph continues, else its own ord.

    A continuation follows the item without a gap of other paragraphs, has one line, no mark, about the item's
    size and is indented beyond it; paras has kind (null without a mark), size, x0, n_lines and align.
    """
    w = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    item = F.last(F.when(F.col("kind").isNotNull(), F.struct("ord", "size", "x0")), ignorenulls=True).over(w)
    held = paras.withColumn("item", item)
    fits = F.col("kind").isNull() & F.col("item").isNotNull() & (F.col("n_lines") == 1) & (F.abs(F.col("size") - F.col("item.size")) <= 1) & (F.col("x0") > F.col("item.x0") + indent) & ~F.col("align").isin("center", "right")
    # the run under an item ends with the first paragraph that does not fit
    broken = F.sum(F.when(F.col("kind").isNull() & ~F.coalesce(F.col("fits"), F.lit(False)), 1).otherwise(0)).over(Window.partitionBy("doc_id", "item.ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    marked = held.withColumn("fits", fits).withColumn("broken", broken)
    return marked.withColumn("head", F.when(F.coalesce(F.col("fits"), F.lit(False)) & (F.col("broken") == 0), F.col("item.ord")).otherwise(F.col("ord"))).drop("item", "fits", "broken")


#: Opening and closing brackets that a line has to balance.
_OPEN, _CLOSE = "([{", ")]}"


def _balanced(text: Column) -> Column:
    """Whether no bracket closes before one is open, and all close."""
    steps = F.transform(F.split(F.regexp_replace(text, r"[^()\[\]{}]", ""), ""), lambda b: F.when(b.isin(*_OPEN), 1).when(b.isin(*_CLOSE), -1).otherwise(0))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))
    return F.aggregate(steps, zero, lambda s, d: F.struct((s["depth"] + d).alias("depth"), F.least(s["least"], s["depth"] + d).alias("least")), lambda s: (s["depth"] == 0) & (s["least"] == 0))


def order_line(words: DataFrame, keys: list[str], *, base: Column | None = None) -> DataFrame:
    """Adds rtl, pos (the logical place) and read (the text as it is read) to a line's words (x, seq, str).

    A word with letters has their direction; a number next to a left-to-right word is of it; another word without
    letters takes the direction of the nearest ones with it on its two sides if they agree, else the base's, which
    also stands in beyond the line's ends. The base, if none is given, is right to left when right-to-left words
    have more letters than others; where no word has any, when most are of Arabic script. Runs of one direction
    are read in the base's order, right-to-left runs from the right. Right-to-left words are normalised, and
    brackets repaired: some producers write a right-to-left bracket as the sign that it looks like, so a line whose
    brackets, in logical order, do not balance, and do once its right-to-left words of brackets alone are mirrored, gets these mirrored.
    """
    w, line = Window.partitionBy(*keys).orderBy("x", "seq"), Window.partitionBy(*keys)
    letters, script = letter_count(F.col("str")), is_arabic(F.col("str"))
    held = words.withColumn("__own", F.when(letters > 0, script))
    if base is None:
        right, left = F.sum(F.when(script, letters).otherwise(0)).over(line), F.sum(F.when(script, 0).otherwise(letters)).over(line)
        base = F.when(right + left > 0, right > left).otherwise(2 * F.count_if(script).over(line) > F.count("*").over(line))
    held = held.withColumn("__base", base)
    touched = (F.lag("__own").over(w) == F.lit(False)) | (F.lead("__own").over(w) == F.lit(False))
    held = held.withColumn("__own", F.when(F.col("__own").isNull() & F.col("str").rlike("[0-9]") & F.coalesce(touched, F.lit(False)), False).otherwise(F.col("__own")))
    before = F.coalesce(F.last("__own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "__base")
    after = F.coalesce(F.first("__own", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)), "__base")
    held = held.withColumn("rtl", F.coalesce("__own", F.when(before == after, before).otherwise(F.col("__base"))))
    new = F.when(F.col("rtl") == F.lag("rtl").over(w), 0).otherwise(1)
    runs = held.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sign = lambda flag, c: F.when(flag, -F.col(c)).otherwise(F.col(c))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(sign(F.col("__base"), "__run"), sign(F.col("rtl"), "x"), "seq"))
    placed = runs.withColumn("pos", place.cast("int")).drop("__own", "__base", "__new", "__run")
    # a line's words are gathered, as what comes out of Python has lost its dealing and could not be put in lines again without a shuffle
    names = [c for c in placed.columns if c not in keys]
    held = _gathered(placed, keys).withColumn("plain", F.transform("words", lambda v: F.when(v["rtl"], v["str"])))
    held = held.withColumn("folded", normalized_all(F.col("plain")))
    held = once(held, reads=F.transform("words", lambda v, i: F.when(v["rtl"], F.get("folded", i)).otherwise(v["str"])))
    held = once(held, turned=F.transform("words", lambda v, i: F.when(v["rtl"] & F.get("reads", i).rlike(r"^[\s()\[\]{}]+$"), F.translate(F.get("reads", i), _OPEN + _CLOSE, _CLOSE + _OPEN)).otherwise(F.get("reads", i))))
    # lines with nothing to mirror are most
    whole = lambda c: F.array_join(c, "")
    mirror = F.coalesce((F.col("turned") != F.col("reads")) & ~_balanced(whole("reads")) & _balanced(whole("turned")), F.lit(False))
    held = once(held, read=F.when(mirror, F.col("turned")).otherwise(F.col("reads")))
    return held.select(*keys, F.inline(F.transform("words", lambda v, i: F.struct(*[v[c].alias(c) for c in names], F.get("read", i).alias("read"))))).select(*placed.columns, "read")


def _gathered(words: DataFrame, keys: list[str]) -> DataFrame:
    """keys and words: a line's words by pos."""
    return words.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", *[c for c in words.columns if c != "pos" and c not in keys]))).alias("words"))


def _turned_words(words: Column) -> Column:
    """The words of a right-to-left row (by x), in logical order: runs from the right, each right-to-left one from its right, as <v, turned>: its text with brackets alone mirrored (see :func:`order_line`)."""
    rtl = lambda v: ~v["str"].rlike("[A-Za-z]")
    zero = F.array().cast("array<int>")
    last = lambda s: F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0))
    marked = F.transform(words, lambda v, i: F.struct(v.alias("v"), rtl(v).alias("rtl"), (rtl(v) != rtl(F.get(words, i - 1))).alias("new")))
    runs = F.aggregate(marked, zero, lambda s, m: F.concat(s, F.array(last(s) + F.when(m["new"], 1).otherwise(0))))
    sign = lambda m: F.when(m["rtl"], -m["v"]["x"]).otherwise(m["v"]["x"])
    order = F.sort_array(F.transform(F.arrays_zip(marked.alias("m"), runs.alias("run")), lambda z: F.struct((-z["run"]).alias("run"), sign(z["m"]).alias("at"), z["m"]["v"]["seq"].alias("seq"), z["m"].alias("m"))))
    mirrored = lambda t: F.translate(t, _OPEN + _CLOSE, _CLOSE + _OPEN)
    read = lambda m: F.when(m["rtl"] & m["v"]["str"].rlike(r"^[\s()\[\]{}]+$"), mirrored(m["v"]["str"])).otherwise(m["v"]["str"])
    return F.transform(order, lambda o: F.struct(o["m"]["v"].alias("v"), read(o["m"]).alias("turned")))


def _line_rows(items: DataFrame) -> DataFrame:
    """doc_id, page, line, rtl, words (seq, y, x, w, size, str) in logical order, reads, pieces, stops and text: a row for each line; see :func:`logical_lines`.

    A page's words are gathered once, and a line's cut out of them whole: it is ordered and spaced inside of its row.
    """
    height = "height" if "height" in items.columns else "size"
    shown = items.where(F.char_length("str") > 0)

    def middle(rows: Column, c: str) -> Column:
        """The upper median of what is positive."""
        held = F.sort_array(F.filter(F.transform(rows, lambda r: r[c]), lambda v: v > 0))
        return F.get(held, F.floor(F.size(held) / 2).cast("int"))

    high = lambda rows: F.coalesce(middle(rows, height).cast("double"), F.lit(10.0))
    rows = baseline_rows(shown, list(dict.fromkeys([*LINE_COLUMNS, height])), tol=lambda rows: F.greatest(F.lit(3.0), 0.6 * high(rows)))
    rows = once(rows, __high=high(F.col("rows")), __wide=middle(F.col("rows"), "w"))
    rows = rows.withColumn("__blank", F.least(0.4 * F.coalesce("__wide", 0.5 * F.col("__high")), 0.15 * F.col("__high")))
    number = lambda i: F.get("rows", i)["line"]
    starts = F.filter(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: (i == 0) | (number(i) != number(i - 1)))
    word = lambda r: F.struct(*[r[c].alias(c) for c in ("x", "seq", "y", "w", "size", "str")])
    own = lambda a, k: F.slice("rows", a + 1, F.coalesce(F.get("starts", k + 1), F.size("rows")) - a)
    cut = F.transform("starts", lambda a, k: F.struct(number(a).alias("line"), F.sort_array(F.transform(own(a, k), word)).alias("words")))
    lines = once(rows, starts=starts).select(*PAGE, "__blank", F.inline(cut))
    arabic = F.filter("words", lambda v: is_arabic(v["str"]))
    lettered = F.filter("words", lambda v: is_arabic(v["str"]) | v["str"].rlike(r"\p{L}"))
    lines = lines.withColumn("rtl", F.exists("words", lambda v: is_arabic(v["str"])) & (2 * F.size(arabic) > F.size(lettered)))
    # lines that are read as they stand are most
    lines = once(lines, turned=F.when(F.col("rtl"), _turned_words(F.col("words"))))
    whole = lambda f: F.array_join(F.transform("turned", f), "")
    mirror = F.coalesce(F.exists("turned", lambda t: t["turned"] != t["v"]["str"]) & ~_balanced(whole(lambda t: t["v"]["str"])) & _balanced(whole(lambda t: t["turned"])), F.lit(False))
    lines = once(lines, mirror=F.when(F.col("rtl"), mirror))
    repaired = F.transform("turned", lambda t: t["v"].withField("str", F.when(F.col("mirror"), t["turned"]).otherwise(t["v"]["str"])))
    lines = once(lines, ordered=F.when(F.col("rtl"), repaired).otherwise(F.col("words"))).select(*PAGE, "line", "rtl", "__blank", F.col("ordered").alias("words"))
    # gathered before Python, whose rows have lost their dealing
    lines = lines.withColumn("plain", F.transform("words", lambda v: v["str"]))
    lines = lines.withColumn("reads", normalized_all(F.col("plain")))

    def gap(v: Column, up: Column) -> Column:
        return F.greatest(v["x"], up["x"]) - F.when(up["x"] <= v["x"], up["x"] + up["w"]).otherwise(v["x"] + v["w"])

    piece = lambda v, i: F.concat(F.when(gap(v, F.get("words", i - 1)) > F.col("__blank"), " ").otherwise(""), F.get("reads", i))
    lines = once(lines, pieces=F.transform("words", piece))
    zero = F.array().cast("array<int>")
    stops = F.aggregate("pieces", zero, lambda s, p: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0)) + F.char_length(p))))
    return once(lines, stops=stops, text=F.array_join("pieces", ""))


def logical_lines(items: DataFrame) -> DataFrame:
    """Items (str, x, y, w, height or size) with line, rtl (of the line), pos, start (offset in the line's text), read and the line's text.

    The page sets the tolerances: items within 0.6 median heights (3 points at least) of a row's first baseline
    are of the row, and a blank is put where the gap between neighbours is over 0.4 median widths or 0.15 median
    heights, whichever is less. A row is right to left if most of its items with a letter are of Arabic script;
    it is then read from the right, runs with a Latin letter forward, and brackets are repaired.
    """
    read = lambda i: F.get("reads", i)
    word = lambda v, i: F.struct(*[v[c].alias(c) for c in ("seq", "y", *LINE_COLUMNS)], F.col("rtl").alias("rtl"), (i + 1).alias("pos"), read(i).alias("read"), (F.get("stops", i) - F.char_length(read(i))).alias("start"))
    return _line_rows(items).select(*PAGE, "line", "text", F.inline(F.transform("words", word)))


def search_lines(items: DataFrame, query: str, *, case: bool = False, rtl: bool = False) -> DataFrame:
    """doc_id, page, line, start, found and the box of the words that a match touches; matches may span items. With ``rtl`` in right-to-left lines only."""
    p = pattern_of(query, case=case)
    # words are looked up in the row of the line that has the match: lines are made once, and nothing is joined
    lines = _line_rows(items).where("rtl") if rtl else _line_rows(items)
    hits = lines.where(F.col("text").rlike(p)).select(*PAGE, "line", "words", "reads", "stops", F.explode(match_offsets(F.col("text"), p)).alias("m"))
    size = lambda i: F.char_length(F.get("reads", i))
    touched = F.filter("words", lambda v, i: (F.get("stops", i) - size(i) < F.col("m.start") + F.char_length("m.found")) & (F.col("m.start") < F.get("stops", i)))
    box = once(hits, touched=touched).where(F.size("touched") > 0)
    side = lambda f: F.transform("touched", f)
    return box.select(*PAGE, "line", F.col("m.start").alias("start"), F.col("m.found").alias("found"), F.array_min(side(lambda v: v["x"])).alias("x0"), F.array_max(side(lambda v: v["x"] + v["w"])).alias("x1"), F.array_min(side(lambda v: v["y"])).alias("y0"), F.array_max(side(lambda v: v["y"] + v["size"])).alias("y1"))


def search_pages(items: DataFrame, query: str, *, case: bool = False, cap: int = PAGE_CAP) -> DataFrame:
    """doc_id, page, n, kind, place, start, found, x0, x1: a page's first ``cap`` matches of all kinds together.

    In item order come matches inside items (kind item, at its seq) and, of a query that is not Arabic, items that
    hold it in their compatibility form only (form, the whole item); an Arabic query's matches in right-to-left lines
    follow (line, at the line's number).
    """
    inside = search_items(items, query, case=case).select(*PAGE, F.lit("item").alias("kind"), F.col("seq").alias("place"), "start", "found", F.col("mx").alias("x0"), (F.col("mx") + F.col("mw")).alias("x1"))
    if arabic_query(query):
        more = search_lines(items, query, case=case, rtl=True).select(*PAGE, F.lit("line").alias("kind"), F.col("line").cast("long").alias("place"), "start", "found", "x0", "x1")
    else:
        whole = items.join(search_normalized(items, query, case=case), [*PAGE, "seq"], "left_semi") if query.strip() else items.where("false")
        more = whole.select(*PAGE, F.lit("form").alias("kind"), F.col("seq").alias("place"), F.lit(0).alias("start"), F.col("str").alias("found"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"))
    n = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.col("kind") == "line", "place", "start"))
    return inside.unionByName(more).withColumn("n", n).where(F.col("n") <= cap)


def search_all(items: DataFrame, elements: DataFrame, query: str, *, case: bool = False) -> DataFrame:
    """kind, doc_id, page, id, found: items and overlay texts that hold the query."""
    p: Column | str = pattern_of(query, case=case)
    a = items.where(F.col("str").rlike(p)).select(F.lit("source").alias("kind"), *PAGE, F.col("seq").alias("id"), F.col("str").alias("found"))
    b = elements.where(F.col("text").rlike(p)).select(F.lit("overlay").alias("kind"), *PAGE, F.col("element_id").alias("id"), F.col("text").alias("found"))
    return a.unionByName(b)


def settle_lines(lines: DataFrame, *, low: float = 0.35, high: float = 0.65) -> DataFrame:
    """Adds rtl to lines (para, line, right and left letters, x0, x1, size and the column's c0 and c1).

    A line is right to left if more of its letters are; one whose share lies from ``low`` to ``high`` is undecided.
    It takes the direction of its paragraph's letters, if these are decided; else that of the one side that it is
    flush with (to half a size, two points at least). If it is flush with both, it takes the side of the
    paragraph's other lines that are flush with one side only, if they agree. Any other line stays as it is.
    """
    share = lambda r, l: F.when(r + l > 0, r / (r + l))
    para = Window.partitionBy(*PAGE, "para")
    tol = F.greatest(F.lit(2.0), 0.5 * F.col("size"))
    at_left, at_right = F.abs(F.col("x0") - F.col("c0")) <= tol, F.abs(F.col("c1") - F.col("x1")) <= tol
    one_side = F.when(at_right & ~at_left, True).when(at_left & ~at_right, False)
    held = lines.withColumn("__side", one_side).withColumn("__both", at_left & at_right)
    own, whole = share(F.col("right"), F.col("left")), share(F.sum("right").over(para), F.sum("left").over(para))
    # a line that is flush with both sides is none of those that agree
    agreed = F.when(F.min("__side").over(para) == F.max("__side").over(para), F.max("__side").over(para))
    settled = F.when(~whole.between(low, high), whole > 0.5).otherwise(F.coalesce("__side", F.when(F.col("__both"), agreed)))
    keep = F.col("right") > F.col("left")
    return held.withColumn("rtl", F.when(own.between(low, high), F.coalesce(settled, keep)).otherwise(keep)).drop("__side", "__both")


#: Roles of structure nodes that are a block of their own, besides headings.
BODY_ROLES = ("P", "Note", "Caption", "BlockQuote", "Quote")


def tree_blocks(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, node_id, path, kind (heading, body, item, cell), level, depth, table_id, text: blocks of a structure tree in reading order.

    nodes has node_id, parent_id, ord (among siblings) and role; items has leaf_id (a node), seq and str.
    Headings and body roles are blocks unless they lie in a list item or a cell, whose text then is theirs;
    lists nest, a nested list's items are blocks of their own; cells know their table; figures are left out
    with all that is in them; other roles are looked through. Blocks without text are left out.
    """
    role, own = F.col("role"), F.lpad(F.col("ord").cast("string"), 19, "0")
    heading = role.rlike("^(H[1-6]?|Title)$")
    level = F.when(role.rlike("^H[1-6]$"), F.substring(role, 2, 1).cast("int")).otherwise(1)
    kind = F.when(heading, "heading").when(role.isin(*BODY_ROLES), "body").when(role == "LI", "item").when(role.isin("TD", "TH"), "cell")
    state = {
        "path": (own, F.concat("up_path", F.lit("."), own)),
        "hidden": (role == "Figure", F.col("up_hidden") | (role == "Figure")),
        "depth": ((role == "L").cast("int"), F.col("up_depth") + (role == "L").cast("int")),
        "table_id": (F.when(role == "Table", F.col("node_id")), F.when(role == "Table", F.col("node_id")).otherwise(F.col("up_table_id"))),
    }
    fresh = F.struct(F.col("node_id").alias("id"), kind.alias("kind"), F.when(heading, level).otherwise(0).alias("level"))
    none = F.lit(None).cast(f"struct<id:{nodes.schema['node_id'].dataType.simpleString()},kind:string,level:int>")
    inside = F.coalesce(F.col("up_block.kind").isin("item", "cell"), F.lit(False))
    block = F.when(role.isin("L", "Table"), none).when(role.isin("LI", "TD", "TH"), fresh).when(kind.isNotNull() & ~inside, fresh).otherwise(F.col("up_block"))
    roots = nodes.where("parent_id IS NULL").select("doc_id", "node_id", *[r.alias(n) for n, (r, _) in state.items()], F.when(kind.isNotNull(), fresh).otherwise(none).alias("block"))
    tree = by_level(roots, nodes, {n: s for n, (_, s) in state.items()} | {"block": block})
    seen = tree.where(~F.col("hidden") & F.col("block").isNotNull())
    place = seen.where(F.col("block.id") == F.col("node_id")).select("doc_id", "node_id", "path", F.col("block.kind").alias("kind"), F.col("block.level").alias("level"), F.when(F.col("block.kind") == "item", F.col("depth")).otherwise(0).alias("depth"), F.when(F.col("block.kind") == "cell", F.col("table_id")).alias("table_id"))
    leaves = seen.select("doc_id", F.col("node_id").alias("leaf_id"), F.col("block.id").alias("node_id"), F.col("path").alias("leaf_path"))
    # the tree's order, not the page's
    words = F.array_sort(F.collect_list(F.struct("leaf_path", "seq", "str")))
    texts = items.join(leaves, ["doc_id", "leaf_id"]).groupBy("doc_id", "node_id").agg(F.array_join(F.transform(words, lambda w: w["str"]), " ").alias("text"))
    return place.join(texts, ["doc_id", "node_id"]).where(F.trim("text") != "")


def tree_tables(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, table_id, r, c, text: the full grids of the tables in a structure tree (nodes and items as in :func:`tree_blocks`).

    A table's rows are its TR nodes, under it or under row groups; a row's cells are its TD and TH nodes. Cells take
    the text of all that is in them but for tables of their own, which have their own grid, in the order of the
    tree. Rows are filled up to the widest with empty cells; tables without any text are left out.
    """
    role, own = F.upper("role"), F.lpad(F.col("ord").cast("string"), 19, "0")
    cell = role.isin("TD", "TH") & F.col("up_row").isNotNull()
    state = {
        "path": (own, F.concat("up_path", F.lit("."), own)),
        # the table whose rows may come next; the table of a row; the row and table of a cell; the cell of a leaf
        "grid": (F.when(role == "TABLE", F.col("node_id")), F.when(role == "TABLE", F.col("node_id")).when(role.isin("THEAD", "TBODY", "TFOOT"), F.col("up_grid"))),
        "row": (None, F.when((role == "TR") & F.col("up_grid").isNotNull(), F.struct(F.col("up_grid").alias("table_id"), F.col("node_id").alias("id")))),
        "cell_row": (None, F.when(cell, F.col("up_row"))),
        "cell": (None, F.when(role == "TABLE", None).when(cell, F.col("node_id")).otherwise(F.col("up_cell"))),
    }
    kind = nodes.schema["node_id"].dataType.simpleString()
    pair = f"struct<table_id:{kind},id:{kind}>"
    none = {"row": F.lit(None).cast(pair), "cell_row": F.lit(None).cast(pair), "cell": F.lit(None).cast(kind)}
    roots = nodes.where("parent_id IS NULL").select("doc_id", "node_id", *[(none[n] if r is None else r).alias(n) for n, (r, _) in state.items()])
    tree = by_level(roots, nodes, {n: s for n, (_, s) in state.items()})
    rows = tree.where("row IS NOT NULL").select("doc_id", F.col("row.table_id").alias("table_id"), F.col("node_id").alias("row_id"), (F.row_number().over(Window.partitionBy("doc_id", "row.table_id").orderBy("path")) - 1).alias("r"))
    cells = tree.where("cell_row IS NOT NULL").select("doc_id", F.col("cell_row.id").alias("row_id"), F.col("node_id").alias("cell"), (F.row_number().over(Window.partitionBy("doc_id", "cell_row.id").orderBy("path")) - 1).alias("c"))
    leaves = tree.where("cell IS NOT NULL").select("doc_id", F.col("node_id").alias("leaf_id"), "cell", "path")
    words = F.array_sort(F.collect_list(F.struct("path", "seq", "str")))
    joined = F.trim(F.regexp_replace(F.array_join(F.transform(words, lambda w: w["str"]), " "), r"\s+", " "))
    texts = items.join(leaves, ["doc_id", "leaf_id"]).groupBy("doc_id", "cell").agg(joined.alias("text"))
    placed = rows.join(cells, ["doc_id", "row_id"], "left").join(texts, ["doc_id", "cell"], "left")
    # a row as a map of its cells: its table's width fills it up
    held = placed.groupBy("doc_id", "table_id", "r").agg(F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("c", F.coalesce("text", F.lit("")).alias("text"))))).alias("held"), F.coalesce(F.max("c") + 1, F.lit(0)).alias("n"))
    table = Window.partitionBy("doc_id", "table_id")
    some = F.max(F.exists(F.map_values("held"), lambda t: t != "")).over(table)
    whole = held.withColumn("n", F.max("n").over(table)).withColumn("some", some).where("some")
    every = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.struct(c.alias("c"), F.coalesce(F.try_element_at("held", c), F.lit("")).alias("text")))
    return whole.select("doc_id", "table_id", "r", F.inline(every))
