"""Versions, packages and object graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.lineage import written

from .redact import outside_clip


def page_fingerprints(items: DataFrame) -> DataFrame:
    """doc_id, page, print: 128 bits of a page's strings with their origins at two decimals, in order."""
    at = [F.floor(F.col(c) * 100 + 0.5) for c in ("x", "y")]
    rows = F.sort_array(F.collect_list(F.struct("seq", F.xxhash64("str", *at).alias("g"), F.xxhash64(*at, "str").alias("h"))))
    held = items.groupBy("doc_id", "page").agg(rows.alias("rows"))
    return held.select("doc_id", "page", F.array(F.xxhash64(F.transform("rows", lambda r: r["g"])), F.xxhash64(F.transform("rows", lambda r: r["h"]))).alias("print"))


def page_mismatches(original: DataFrame, copy: DataFrame) -> DataFrame:
    """doc_id, page: pages of the original that the copy lacks or has otherwise."""
    a = page_fingerprints(original)
    b = page_fingerprints(copy).withColumnRenamed("print", "other")
    return a.join(b, ["doc_id", "page"], "left").where(~F.col("print").eqNullSafe(F.col("other"))).select("doc_id", "page")


def resolve_rels(rels: DataFrame) -> DataFrame:
    """owner, rel_id, target: external hyperlinks of a package."""
    return rels.where((F.col("mode") == "External") & F.col("type").endswith("/hyperlink") & F.col("target").isNotNull()).select("owner", "rel_id", "target")


def resolve_numbering(nums: DataFrame, abstracts: DataFrame) -> DataFrame:
    """num_id, format: two hops to the format of level 0; other where there is none."""
    level = abstracts.where("level = 0").select(F.col("abstract_id").alias("a"), "format")
    return nums.join(level, F.col("abstract_id") == F.col("a"), "left").select("num_id", F.coalesce("format", F.lit("other")).alias("format"))


def resolve_target(owner: Column, target: Column) -> Column:
    """The path that a relationship's target means: from the root if it begins with a slash, else from the owner's folder, with ``.`` and ``..`` folded (beyond the root they fall away); the package itself owns what has no owner."""
    folder = F.regexp_extract(F.coalesce(owner, F.lit("")), "^(.*/)?", 1)
    none = F.array().cast("array<string>")

    def step(held: Column, part: Column) -> Column:
        up = F.slice(held, F.lit(1), F.greatest(F.lit(0), F.size(held) - 1))
        return F.when(part.isin("", "."), held).when(part == "..", up).otherwise(F.concat(held, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(F.concat(folder, target), "/"), none, step), "/")
    return F.when(target.startswith("/"), F.substring(target, F.lit(2), F.char_length(target))).otherwise(folded)


def part_key(path: Column) -> Column:
    """What two names of one part have in common: percent codes decoded, if they are all in order, and lower case."""
    decoded = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    # codes that are no UTF-8 come out as the replacement sign
    bad = decoded.contains("\ufffd") & ~path.contains("\ufffd")
    return F.lower(F.when(decoded.isNull() | bad, path).otherwise(decoded))


def orphan_parts(parts: DataFrame, rels: DataFrame, overrides: DataFrame, attrs: DataFrame) -> DataFrame:
    """package, path: media parts that nothing uses.

    A part is live if the content types name it, or a relationship (owner, rel_id, target as written) points to it
    whose id stands among its owner's attribute values, or whose owner is the package (null) or a part that is
    not there or cannot be read. A package with an unreadable relationship part loses nothing. Targets are resolved
    against their owner, and paths compared decoded and without case.
    """
    media = parts.where(part_key(F.col("path")).contains("/media/")).select("package", "path", part_key(F.col("path")).alias("p"))
    used = rels.where("rel_id IS NOT NULL AND target IS NOT NULL").select("package", "owner", "rel_id", part_key(resolve_target(F.col("owner"), F.col("target"))).alias("p"))
    readable = parts.where("readable").select("package", F.col("path").alias("owner")).distinct()
    live = used.join(attrs.select("package", "owner", F.col("value").alias("rel_id")).distinct(), ["package", "owner", "rel_id"], "left_semi").select("package", "p")
    kept = used.join(readable, ["package", "owner"], "left_anti").select("package", "p")
    named = overrides.select("package", part_key(F.regexp_replace("path", "^/", "")).alias("p"))
    closed = parts.where(~F.col("readable") & F.col("path").endswith(".rels")).select("package").distinct()
    return media.join(live.union(kept).union(named).distinct(), ["package", "p"], "left_anti").join(closed, "package", "left_anti").select("package", "path")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node: the closure of the roots over edges (src, dst), cycles allowed.

    Each round joins only the nodes found in the last one and is written to the checkpoint folder by itself; every
    sixteenth puts the parts written so far together, so that plans stay short and a node is seldom written again.
    """
    e = written(edges.select("src", "dst").distinct())
    frontier = seen = written(roots.select("node").distinct())
    rounds = 0
    while True:
        frontier = written(frontier.join(e, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            return seen
        rounds += 1
        seen = seen.union(frontier)
        if rounds % 16 == 0:
            seen = written(seen)


def unreachable(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(reachable(edges, roots), "node", "left_anti")


def dangling_refs(nodes: DataFrame, edges: DataFrame, roots: DataFrame, drops: DataFrame) -> DataFrame:
    """node, kind: reachable targets that do not exist (dangling) or cannot be read (damaged), and dropped objects that are still reachable (dropped).

    nodes has node and readable, drops node, seq and action (drop or assign); an object that was assigned
    after it was dropped does not count. A damaged object may hide references: then every dropped one counts.
    """
    seen = written(reachable(edges.join(nodes.where("readable").select(F.col("node").alias("src")), "src", "left_semi"), roots))
    dangling = seen.join(nodes.select("node"), "node", "left_anti").select("node", F.lit("dangling").alias("kind"))
    damaged = nodes.where("NOT readable").select("node").join(seen, "node", "left_semi").select("node", F.lit("damaged").alias("kind"))
    gone = drops.groupBy("node").agg(F.max_by("action", "seq").alias("last")).where("last = 'drop'").select("node")
    any_damaged = not damaged.isEmpty()
    dropped = (gone if any_damaged else gone.join(seen, "node", "left_semi")).select("node", F.lit("dropped").alias("kind"))
    return dangling.unionByName(damaged).unionByName(dropped)


def align_items(a: DataFrame, b: DataFrame, *, tol: float = 0.01) -> DataFrame:
    """doc_id, page, a_seq, b_seq: the k-th item of one extraction with the k-th of the other; a page with any difference in text, place or number is left out."""
    return _aligned(a, b, tol=tol).select("doc_id", "page", "a_seq", "b_seq")


def _aligned(a: DataFrame, b: DataFrame, *, tol: float = 0.01, of_a: tuple[str, ...] = (), of_b: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, page, a_seq, str, x, y and ``of_a`` of the first, b_seq and ``of_b`` of the other extraction; see :func:`align_items`.

    The sides are laid below each other, as a full join would lose their dealing; the names in ``of_b`` are not in a.
    """
    keys = ["doc_id", "page"]
    shared = ["seq", "str", "x", "y"]
    left = a.select(*keys, F.lit(0).alias("side"), *shared, *of_a, *[F.lit(None).cast(b.schema[c].dataType).alias(c) for c in of_b])
    right = b.select(*keys, F.lit(1).alias("side"), *shared, *[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in of_a], *of_b)
    both = left.unionByName(right).withColumn("k", F.row_number().over(Window.partitionBy(*keys, "side").orderBy("seq")))
    # the k-th rows of both sides stand next to each other
    near = Window.partitionBy(*keys).orderBy("k", "side")
    held = both.withColumns({"other": F.lead(F.struct("k", *shared, *of_b)).over(near), "up": F.lag("k").over(near)})
    same = (F.col("str") == F.col("other.str")) & (F.abs(F.col("x") - F.col("other.x")) <= tol) & (F.abs(F.col("y") - F.col("other.y")) <= tol)
    good = F.coalesce(F.when(F.col("side") == 0, (F.col("other.k") == F.col("k")) & same).otherwise(F.col("up") == F.col("k")), F.lit(False))
    whole = held.withColumn("ok", F.min(good.cast("int")).over(Window.partitionBy(*keys)))
    return whole.where("ok = 1 AND side = 0").select(*keys, F.col("seq").alias("a_seq"), "str", "x", "y", *of_a, F.col("other.seq").alias("b_seq"), *[F.col(f"other.{c}").alias(c) for c in of_b])


def open_markers(stream: DataFrame) -> DataFrame:
    """Adds k, m_tag and m_k to a page's stream (doc_id, page, seq, kind of item, begin or end, tag, own).

    Begins open a marker and ends close the last open one, if any; k numbers the own markers of a tag on a page from
    0. m_tag and m_k name the innermost own marker that is open at a row; others are looked through. The nesting is
    told by sums and last values over a page, so that no stack is folded: the marker that an end closes is the last
    one begun on its level, and the innermost open one is the last own one begun on the level of own markers.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("seq")
    begin, end = F.col("kind") == "begin", F.col("kind") == "end"
    own = begin & F.coalesce("own", F.lit(False))
    held = stream.withColumn("__sum", F.sum(F.when(begin, 1).when(end, -1).otherwise(0)).over(page))
    # an end with nothing open closes nothing: the lowest sum so far is the ground
    held = held.withColumn("__depth", F.col("__sum") - F.least(F.lit(0), F.min("__sum").over(page)))
    level = F.when(begin, F.col("__depth")).when(end, F.coalesce(F.lag("__depth").over(page), F.lit(0)))
    held = held.withColumn("__level", level)
    on_level = Window.partitionBy("doc_id", "page", "__level").orderBy("seq")
    closes = end & (F.col("__level") > 0) & F.coalesce(F.last(F.when(begin, own), ignorenulls=True).over(on_level), F.lit(False))
    held = held.withColumn("__owns", F.sum(F.when(own, 1).when(closes, -1).otherwise(0)).over(page.rowsBetween(Window.unboundedPreceding, 0)))
    held = held.withColumn("k", F.when(own, F.sum(F.when(own, 1).otherwise(0)).over(Window.partitionBy("doc_id", "page", "tag").orderBy("seq")) - 1))
    on_own = Window.partitionBy("doc_id", "page", "__owns").orderBy("seq")
    last = F.last(F.when(own, F.struct("tag", "k")), ignorenulls=True).over(on_own)
    held = held.withColumn("__open", F.when(F.col("__owns") > 0, last))
    return held.withColumn("m_tag", F.col("__open.tag")).withColumn("m_k", F.col("__open.k")).drop("__sum", "__depth", "__level", "__owns", "__open")


def carry_clips(items: DataFrame, stream: DataFrame, clips: DataFrame) -> DataFrame:
    """doc_id, page, seq, m_tag, m_k, hidden: the items of a page with the innermost marker of the marked extraction that each stands in.

    ``stream`` is the marked extraction (see :func:`open_markers`; items have str, x, y), ``clips`` (doc_id, page,
    tag, k, cx0 to cy1) the clip of each own marker; null corners clip nothing. hidden is true for an item, not blank
    and with a finite box, that lies wholly outside its marker's clip, or whose clip has no area. A page whose two
    extractions differ in number, text or place of items, or on which markers and clips are not one for one, is
    refused: none of its rows come. Clips of a page without items count for nothing.
    """
    keys = ["doc_id", "page"]
    texts = open_markers(stream).where("kind = 'item'").select(*keys, "seq", "str", "x", "y", "m_tag", "m_k")
    pairs = _aligned(items, texts, of_a=("w", "size"), of_b=("m_tag", "m_k"))
    # the own markers' numbers need none of the items
    of_tag = Window.partitionBy(*keys, "tag").orderBy("seq")
    begun = stream.where((F.col("kind") == "begin") & F.coalesce("own", F.lit(False))).select(*keys, "tag", (F.count(F.lit(1)).over(of_tag) - 1).alias("k"), F.lit(True).alias("begun"))
    boxes = clips.select(*keys, "tag", "k", "cx0", "cy0", "cx1", "cy1", F.lit(True).alias("clipped"))
    refused = begun.join(boxes, [*keys, "tag", "k"], "full").where("begun IS NULL OR clipped IS NULL").select(*keys).distinct()
    own = boxes.select(*keys, F.col("tag").alias("m_tag"), F.col("k").alias("m_k"), "cx0", "cy0", "cx1", "cy1")
    j = pairs.join(refused, keys, "left_anti").join(own, [*keys, "m_tag", "m_k"], "left")
    return j.select(*keys, F.col("a_seq").alias("seq"), "m_tag", "m_k", ((F.trim("str") != "") & outside_clip()).alias("hidden"))


def export_fields(widgets: DataFrame, values: DataFrame) -> DataFrame:
    """src_id, name, values: one row for each first widget of a name; the user's value else the source's; names with a redacted widget are left out, and so are empty ones that the user has not set.

    values is an array: check boxes and radios without value are Off, a list's chosen entries (one a line) stand each
    by itself, and a list without any is left out.
    """
    covered = widgets.where("redacted").select("src_id", "name").distinct()
    w = Window.partitionBy("src_id", "name").orderBy("ord")
    first = widgets.join(covered, ["src_id", "name"], "left_anti").withColumn("n", F.row_number().over(w)).where("n = 1")
    j = first.join(values.select("src_id", "name", F.col("value").alias("user_value")), ["src_id", "name"], "left")
    kept = j.withColumn("value", F.coalesce("user_value", "source_value", F.lit(""))).where((F.col("value") != "") | F.col("user_value").isNotNull())
    one = F.when(F.col("kind").isin("checkbox", "radio") & (F.col("value") == ""), "Off").otherwise(F.col("value"))
    kept = kept.withColumn("values", F.when(F.col("kind") == "list", F.split("value", "\n")).otherwise(F.array(one)))
    return kept.where((F.col("kind") != "list") | (F.col("value") != "")).select("src_id", "name", "values")


def import_fields(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """name, src_id, kind, value: fields go to every source that has their name (its first kind); Off is empty; names that no source has come with src_id null."""
    kinds = widgets.groupBy("src_id", "name").agg(F.min_by("kind", "ord").alias("kind"))
    return fields.join(kinds, "name", "left").select("name", "src_id", "kind", F.when(F.col("value") == "Off", "").otherwise(F.col("value")).alias("value"))


def fillable_widgets(df: DataFrame) -> DataFrame:
    """Adds kind to form widgets (type, flags, name): text, checkbox, radio, choice or list; push buttons, unnamed and unknown ones go."""
    has = lambda bit: F.col("flags").bitwiseAND(F.lit(1 << (bit - 1))) != 0
    kind = F.when(F.col("type") == "Tx", "text").when((F.col("type") == "Btn") & has(17), None).when((F.col("type") == "Btn") & has(16), "radio").when(F.col("type") == "Btn", "checkbox").when((F.col("type") == "Ch") & ~has(18) & has(22), "list").when(F.col("type") == "Ch", "choice")
    return df.withColumn("kind", kind).where("kind IS NOT NULL AND name IS NOT NULL AND name <> ''")
