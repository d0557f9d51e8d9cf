"""Page manifests (source_id, page_id, position) as tables: ranges, merges, order, crops and running numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import to_display_point
from folioflow.functions.lineage import written

#: Widths and heights of blank pages in points.
BLANKS = {"A4": (595.28, 841.89), "Letter": (612.0, 792.0), "A3": (841.89, 1190.55), "A5": (419.53, 595.28)}


def select_pages(manifest: DataFrame, spec: str, *, key: str = "source_id") -> DataFrame:
    """Pages of every source whose position is in a spec such as ``1-3, 5``; ranges run either way, bad parts are left out, and nothing is expanded beyond the source's length."""
    sizes = manifest.groupBy(key).agg(F.max("position").alias("n"))
    parts = sizes.select(key, "n", F.explode(F.split(F.lit(spec), ",")).alias("part")).select(key, "n", F.trim("part").alias("part")).where(F.col("part").rlike(r"^\d{1,9}(?:\s*-\s*\d{1,9})?$"))
    ends = parts.select(key, "n", F.regexp_extract("part", r"^(\d+)", 1).cast("long").alias("a"), F.regexp_extract("part", r"(\d+)$", 1).cast("long").alias("b"))
    held = ends.select(key, F.greatest(F.lit(1), F.least("a", "b")).alias("lo"), F.least("n", F.greatest("a", "b")).alias("hi")).where("lo <= hi")
    wanted = held.select(key, F.explode(F.sequence("lo", "hi")).alias("position")).distinct()
    return manifest.join(wanted, [key, "position"], "left_semi")


def renumber(manifest: DataFrame, *order, key: str = "source_id") -> DataFrame:
    return manifest.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def append_pages(manifest: DataFrame, added: DataFrame, *, key: str = "source_id") -> DataFrame:
    """Added pages (key, page_id, position among themselves) after the last of each source."""
    both = manifest.select(key, "page_id", "position", F.lit(0).alias("part")).unionByName(added.select(key, "page_id", "position", F.lit(1).alias("part")))
    return renumber(both, "part", "position", key=key).drop("part")


def insert_blank(manifest: DataFrame, index: int, size: str = "A4", *, key: str = "source_id") -> DataFrame:
    """A blank page (page_id null) before position ``index`` (1-based) of every source, at the end of shorter ones; later pages move by one."""
    w, h = BLANKS[size]
    blank = manifest.select(key).distinct().select(key, F.lit(None).cast("long").alias("page_id"), (F.lit(index) - 0.5).alias("at"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    pages = manifest.select(key, "page_id", F.col("position").cast("double").alias("at"), F.lit(None).cast("double").alias("width"), F.lit(None).cast("double").alias("height"))
    return renumber(pages.unionByName(blank), "at", key=key).drop("at")


def delete_pages(manifest: DataFrame, gone: DataFrame, elements: DataFrame, *, key: str = "source_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Manifest, elements and sources that remain once the pages in ``gone`` (page_id) are deleted."""
    ids = gone.select("page_id").distinct()
    left = renumber(manifest.join(ids, "page_id", "left_anti"), "position", key=key)
    return left, elements.join(ids, "page_id", "left_anti"), left.select(key).distinct()


def reorder_pages(manifest: DataFrame, order: DataFrame, *, key: str = "source_id") -> DataFrame:
    """The order asked for (key, page_id, at), where it names every page of the source just once (strangers aside); else the source stays as it is."""
    known = order.join(manifest.select(key, "page_id"), [key, "page_id"], "left_semi")
    asked = known.groupBy(key, "page_id").agg(F.count("*").alias("times"), F.min("at").alias("at"))
    j = manifest.join(asked, [key, "page_id"], "left")
    good = F.min(F.coalesce(F.col("times") == 1, F.lit(False)).cast("int")).over(Window.partitionBy(key)) == 1
    marked = j.withColumn("to", F.when(good, F.col("at")).otherwise(F.col("position")))
    return renumber(marked, "to", key=key).select(key, "page_id", "position")


def crop_all(pages: DataFrame, crop: tuple[float, float, float, float], of: tuple[float, float]) -> DataFrame:
    """A crop (x, y, w, h) of a page ``of`` (width, height) on every page (width, height): scaled by the smaller ratio about its centre's place, held inside; crops under a point are left out."""
    x, y, w, h = crop
    k = F.least(F.col("width") / of[0], F.col("height") / of[1])
    cw, ch = F.least(w * k, F.col("width")), F.least(h * k, F.col("height"))
    cx, cy = F.lit((x + w / 2) / of[0]) * F.col("width"), F.lit((y + h / 2) / of[1]) * F.col("height")
    left, low = F.greatest(F.lit(0.0), F.least(cx - cw / 2, F.col("width") - cw)), F.greatest(F.lit(0.0), F.least(cy - ch / 2, F.col("height") - ch))
    return pages.withColumns({"crop_x": left, "crop_y": low, "crop_w": cw, "crop_h": ch}).where("crop_w >= 1 AND crop_h >= 1")


def crop_margins(pages: DataFrame) -> DataFrame:
    """Crop boxes from margins (top, right, bottom, left); bad or negative margins are 0, sides turn with the page, boxes under a point are left out."""
    m = {c: F.when(F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0), 0.0).otherwise(F.col(c)) for c in ("top", "right", "bottom", "left")}
    side = F.pmod("rotation", F.lit(180)) == 90
    w, h = F.when(side, F.col("height")).otherwise(F.col("width")), F.when(side, F.col("width")).otherwise(F.col("height"))
    return pages.withColumns({"crop_x": m["left"], "crop_y": m["top"], "crop_w": w - m["left"] - m["right"], "crop_h": h - m["top"] - m["bottom"]}).where("crop_w >= 1 AND crop_h >= 1")


def stamp_pages(pages: DataFrame, *, prefix: str = "", start: int = 1, digits: int = 6, order: str = "page_id", mode: str = "number") -> DataFrame:
    """Adds n (1-based place in the whole table by a unique ``order`` column) and stamp: prefix and padded number, or in mode ``page`` "n / N".

    A range of pages is chosen after stamping, so that its numbers are those of the whole table. Rows are
    range-partitioned and sorted; the partitions' counts, a row each, are summed up and joined back, so that no
    task holds all rows.
    """
    if mode not in ("number", "page") or not (0 <= start <= 999_999_999_999 and 1 <= digits <= 12):
        raise ValueError("mode is number or page; start has to be within 0 and 999,999,999,999, digits within 1 and 12")
    # written, so that the ranges and the places in them stay what they are
    dealt = written(pages.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftright("__at", 33))
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.select("__part", before.alias("__before"), F.sum("n").over(Window.partitionBy()).alias("__total"))
    # a row for each partition
    numbered = dealt.join(F.broadcast(sums), "__part").withColumn("n", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    number = (F.col("n") + (start - 1)).cast("string")
    pad = F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(digits) - F.length(number)))
    stamp = F.concat(F.lit(prefix), pad, number) if mode == "number" else F.concat_ws(" / ", "n", "__total")
    return numbered.withColumn("stamp", stamp).select(*pages.columns, "n", "stamp")


def stamp_origin(position: Column, margin: float) -> tuple[Column, Column]:
    """Lower left corner (y up) of a stamp (text_w, font_size) on its page (page_width, page_height): t or b, then l, c or r."""
    side, free = F.substring(position, 2, 1), F.col("page_width") - F.col("text_w")
    x = F.when(side == "l", F.lit(margin)).when(side == "r", free - margin).otherwise(free / 2)
    return x, F.when(position.startswith("t"), F.col("page_height") - margin - F.col("font_size")).otherwise(F.lit(margin))


def rotate_elements(elements: DataFrame, turned: DataFrame) -> DataFrame:
    """Overlay elements (page_id, kind, x, y, w, h, points array<struct<x, y>>; y down) of pages that are turned clockwise by ``turn`` (0, 90, 180, 270; page_w and page_h before).

    Elements with points (arrows, ink) follow point by point, with the box around them; others move by their centre and keep their size.
    """
    j = elements.join(turned.select("page_id", "turn", "page_w", "page_h"), "page_id", "left")
    turn = F.coalesce("turn", F.lit(0))
    to = lambda x, y: to_display_point(x, y, F.col("page_w"), F.col("page_h"), turn)
    placed = F.transform("points", lambda p: F.struct(*[c.alias(n) for n, c in zip("xy", to(p["x"], p["y"]), strict=True)]))
    cx, cy = to(F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2)
    moved = j.withColumns({"points": F.when(turn == 0, F.col("points")).otherwise(placed), "cx": cx, "cy": cy})
    by_points = F.size("points") > 0
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    x0, y0 = F.array_min(xs), F.array_min(ys)
    stays = turn == 0
    return moved.select(
        *[c for c in elements.columns if c not in ("x", "y", "w", "h", "points")],
        F.when(stays, F.col("x")).when(by_points, x0).otherwise(F.col("cx") - F.col("w") / 2).alias("x"), F.when(stays, F.col("y")).when(by_points, y0).otherwise(F.col("cy") - F.col("h") / 2).alias("y"),
        F.when(~stays & by_points, F.array_max(xs) - x0).otherwise(F.col("w")).alias("w"), F.when(~stays & by_points, F.array_max(ys) - y0).otherwise(F.col("h")).alias("h"), "points",
    )
