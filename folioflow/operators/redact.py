"""Redaction joins: every one tests boxes of the same page only, so it is a hash join with a residual."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.geometry import box, matrix_box, overlaps, rotated_box

PAGE = ["doc_id", "page"]


def _up(redactions: DataFrame, pages: DataFrame) -> DataFrame:
    """Redactions as y-up boxes with names of their own; pages are only asked for their heights where redactions lack them."""
    r = redactions if "page_height" in redactions.columns else redactions.join(pages.select(*PAGE, "page_height"), PAGE)
    top = F.col("page_height") - F.col("ry_down")
    return r.select(F.col("doc_id").alias("r_doc"), F.col("page").alias("r_page"), F.col("rx").alias("r_x0"), (F.col("rx") + F.col("rw")).alias("r_x1"), (top - F.col("rh")).alias("r_y0"), top.alias("r_y1"))


def _uncovered(df: DataFrame, boxes: dict, redactions: DataFrame, pages: DataFrame, also=None) -> DataFrame:
    """Rows whose box no redaction of their page overlaps; the boxes become columns first, so that they are computed once a row and not once a pair."""
    r = _up(redactions, pages)
    boxed = df.withColumns({f"__{k}": v for k, v in boxes.items()} | ({} if also is None else {"__also": also}))
    hit = overlaps(*[F.col(f"__{k}") for k in ("bx0", "by0", "bx1", "by1")], *[F.col(k) for k in ("r_x0", "r_y0", "r_x1", "r_y1")])
    if also is not None:
        hit = F.col("__also") | hit
    return boxed.join(r, (F.col("doc_id") == F.col("r_doc")) & (F.col("page") == F.col("r_page")) & hit, "left_anti").select(*df.columns)


def redact_items(items: DataFrame, redactions: DataFrame, pages: DataFrame) -> DataFrame:
    """Items that no redaction covers; a footprint is the item's box along its own transform with a quarter em below.

    Vertical text runs along its column with 0.6 of its width on both sides and a tenth of an em at the ends.
    """
    # most text is upright, where the length of the matrix's first row is its one part
    length = F.when(F.col("b") == 0, F.abs("a")).otherwise(F.hypot("a", "b"))
    size = F.when(length > 0, length).otherwise(F.col("size"))
    cos, sin = F.when(length > 0, F.col("a") / length).otherwise(1.0), F.when(length > 0, F.col("b") / length).otherwise(0.0)
    xs, ys = [], []
    for along in (F.lit(0.0), F.col("w")):
        for across in (-0.25 * size, size):
            xs.append(F.col("x") + along * cos - across * sin)
            ys.append(F.col("y") + along * sin + across * cos)
    flat = box(xs, ys)
    if "dir" in items.columns:
        ttb = F.col("dir") == "ttb"
        upright = {"bx0": F.col("x") - 0.6 * F.col("w"), "bx1": F.col("x") + 0.6 * F.col("w"), "by0": F.col("y") - F.col("h") - 0.1 * size, "by1": F.col("y") + 0.1 * size}
        flat = {k: F.when(ttb, upright[k]).otherwise(v) for k, v in flat.items()}
    return _uncovered(items, flat, redactions, pages)


def redact_annots(annots: DataFrame, redactions: DataFrame, pages: DataFrame) -> DataFrame:
    """Annotations (rect array<double>) that no redaction covers; an unreadable rect goes when its page has any."""
    r = F.col("rect")
    bad = F.coalesce((F.size(r) != 4) | F.exists(r, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    at = lambda i: F.get(r, F.lit(i))
    return _uncovered(annots, box([at(0), at(2)], [at(1), at(3)]), redactions, pages, also=bad)


def redact_images(images: DataFrame, redactions: DataFrame, pages: DataFrame) -> DataFrame:
    """Image placements (matrix a-f over the unit square) that no redaction covers."""
    return _uncovered(images, matrix_box(*[F.col(c) for c in "abcdef"]), redactions, pages)


def redact_elements(elements: DataFrame) -> DataFrame:
    """Overlay elements (kind, x, y, w, h, rotation; y down) without those that a redaction element covers; redactions stay."""
    boxed = elements
    for k, v in rotated_box(*[F.col(c) for c in ("x", "y", "w", "h", "rotation")]).items():
        boxed = boxed.withColumn(k, v)
    red = boxed.where("kind = 'redaction'").select(F.col("doc_id").alias("r_doc"), F.col("page").alias("r_page"), *[F.col(c).alias(f"r_{c}") for c in ("bx0", "by0", "bx1", "by1")])
    others = boxed.where("kind <> 'redaction'")
    hit = overlaps(*[F.col(c) for c in ("bx0", "by0", "bx1", "by1")], *[F.col(f"r_{c}") for c in ("bx0", "by0", "bx1", "by1")])
    free = others.join(red, (others["doc_id"] == red["r_doc"]) & (others["page"] == red["r_page"]) & hit, "left_anti")
    return free.unionByName(boxed.where("kind = 'redaction'")).select(*elements.columns)


def outside_clip() -> Column:
    """Whether an item (x, y, w, size) lies wholly outside its clip (cx0 to cy1), edges being inside, or its clip has no area; false without a clip and for unreadable positions."""
    low = F.col("y") - 0.25 * F.col("size")
    outside = (F.col("x") + F.col("w") < F.col("cx0")) | (F.col("x") > F.col("cx1")) | (F.col("y") + F.col("size") < F.col("cy0")) | (low > F.col("cy1"))
    empty = (F.col("cx1") <= F.col("cx0")) | (F.col("cy1") <= F.col("cy0"))
    unreadable = F.isnan("x") | F.isnan("y") | F.isnan("w")
    return F.coalesce(~unreadable & (empty | outside), F.lit(False))


def drop_clipped(items: DataFrame, clips: DataFrame) -> DataFrame:
    """Items that are not wholly outside their clip box; a clip without area hides all of its items, unreadable positions stay."""
    c = clips.select(F.col("doc_id").alias("c_doc"), F.col("page").alias("c_page"), F.col("seq").alias("c_seq"), "cx0", "cy0", "cx1", "cy1")
    j = items.join(c, (F.col("doc_id") == F.col("c_doc")) & (F.col("page") == F.col("c_page")) & (F.col("seq") == F.col("c_seq")), "left")
    return j.where(~outside_clip()).select(*items.columns)
