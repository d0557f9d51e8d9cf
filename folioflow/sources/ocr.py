"""Recognised words, plain texts, overlay texts and saved states as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import to_content_box, to_content_point
from folioflow.functions.text import is_arabic

#: The recognition languages that a code may name.
LANGUAGES = ("eng", "fas", "ara", "deu", "fra", "spa", "rus", "tur")


def ocr_words(raw: DataFrame) -> DataFrame:
    """A row for each word: of nested blocks where those have any, else of the flat list; text trimmed, empty words left out, corners in order, confidence within 0 and 100."""
    deep = F.flatten(F.transform(F.flatten(F.transform(F.flatten(F.transform("blocks", lambda b: b["paragraphs"])), lambda p: p["lines"])), lambda l: l["words"]))
    held = raw.withColumn("deep", F.coalesce(deep, F.filter("words", lambda w: F.lit(False))))
    words = F.when(F.size("deep") > 0, F.col("deep")).otherwise(F.col("words"))
    rows = held.select("doc_id", F.explode(words).alias("w"))
    b = F.col("w.bbox")
    out = rows.select("doc_id", F.col("w.seq").alias("seq"), F.trim(F.regexp_replace("w.text", r"\r\n?", "\n")).alias("text"), F.least(b["x0"], b["x1"]).alias("x0"), F.least(b["y0"], b["y1"]).alias("y0"), F.greatest(b["x0"], b["x1"]).alias("x1"), F.greatest(b["y0"], b["y1"]).alias("y1"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("w.confidence"))).alias("confidence"))
    return out.where(F.col("text").rlike(r"\S"))


def ocr_paragraphs(df: DataFrame) -> DataFrame:
    """doc_id, para, text, rtl: the lines of a text that are not blank."""
    lines = df.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "s")).select("doc_id", "i", F.trim("s").alias("text")).where("text <> ''")
    n = (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).cast("int")
    return lines.select("doc_id", n.alias("para"), "text", is_arabic(F.col("text")).alias("rtl"))


#: Parts of the names of font families by their generic one; the first that fits counts.
GENERIC = {"monospace": "courier|consol|mono|menlo", "serif": "times|georgia|serif|garamond|minion|cambria"}


def overlay_paragraphs(elements: DataFrame, keys: list[str]) -> DataFrame:
    """keys, para, ord, line, text, y, rtl, color, family: the lines of a page's overlay texts (ord, x, y_down, font_size, page_height, text, color, font_family) that are not blank.

    Elements follow one another from the top, then from the left, then by ord; lines are counted down from the
    element's top by its font size (no height: no y). Black is no colour; others lose their sign.
    """
    held = elements.select(*keys, "ord", "x", "y_down", "font_size", "page_height", "color", "font_family", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.col("text").rlike(r"\S"))
    line = (F.row_number().over(Window.partitionBy(*keys, "ord").orderBy("i")) - 1).cast("int")
    para = (F.row_number().over(Window.partitionBy(*keys).orderBy("y_down", "x", "ord", "i")) - 1).cast("int")
    name = F.lower(F.coalesce("font_family", F.lit("")))
    family = F.when(name.rlike(GENERIC["monospace"]), "monospace").when(name.rlike(GENERIC["serif"]), "serif").otherwise("sans-serif")
    color = F.when((F.col("color") != "") & (F.upper("color") != "#000000"), F.upper(F.regexp_replace("color", "^#", "")))
    lines = held.withColumns({"line": line, "para": para, "rtl": is_arabic(F.col("text")), "family": family, "shade": color})
    return lines.select(*keys, "para", "ord", "line", "text", (F.col("page_height") - F.col("y_down") - F.col("line") * F.col("font_size")).alias("y"), "rtl", F.col("shade").alias("color"), "family")


def current_snapshots(df: DataFrame, *, version: int = 1) -> DataFrame:
    """Saved states without a version or of the current one."""
    return df.where(F.col("schema_version").isNull() | (F.col("schema_version") == version))


def normalize_language(code, default: str = "eng"):
    """Known codes joined by ``+`` in order, each once; the default where any is unknown."""
    parts = F.array_distinct(F.transform(F.split(F.lower(code), r"\+"), lambda p: F.trim(p)))
    known = F.forall(parts, lambda p: p.isin(*LANGUAGES))
    return F.when(known & code.isNotNull(), F.array_join(parts, "+")).otherwise(default)


def word_placement(words: DataFrame, *, scale: float, page_height: float) -> DataFrame:
    """Adds px, py, pw, ph in points (y up, a point at least) of words recognised at ``scale``, and where the text's own width is known (text_w) the squeeze in per cent, within 10 and 1000, that makes it fit."""
    if "text_w" in words.columns:
        fit = 100 * F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) / scale) / F.col("text_w")
        words = words.withColumn("squeeze", F.when(F.col("text_w") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(10.0), fit))).otherwise(100.0))
    return words.withColumns({"px": F.col("x0") / scale, "py": page_height - F.col("y1") / scale, "pw": F.greatest(F.lit(1.0), (F.col("x1") - F.col("x0")) / scale), "ph": F.greatest(F.lit(1.0), (F.col("y1") - F.col("y0")) / scale)})


def unrotate_words(words: DataFrame, *, width: float, height: float) -> DataFrame:
    """Words (x0, y0, x1, y1; y down) recognised on an image that was turned clockwise by ``rotation``, on the upright image of the given size; other turns than quarter ones are left out."""
    turn = F.pmod("rotation", F.lit(360))
    b = to_content_box(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(width), F.lit(height), turn)
    upright = words.where(turn.isin(0, 90, 180, 270)).withColumns({f"__{k}": v for k, v in b.items()})
    return upright.withColumns({"x0": F.col("__bx0"), "y0": F.col("__by0"), "x1": F.col("__bx1"), "y1": F.col("__by1")}).drop(*[f"__{k}" for k in b])


#: What the single-byte Latin code page has beyond ASCII and Latin-1.
LATIN_EXTRA = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def word_script(text: Column) -> Column:
    """arabic, latin (all of it can be written in the single-byte Latin code page) or skipped."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "skipped").when(is_arabic(text), "arabic").when(text.rlike(rf"^[\x20-\x7E\xA0-\xFF{LATIN_EXTRA}]+$"), "latin").otherwise("skipped")


def word_elements(words: DataFrame, *, page_width: float, page_height: float) -> DataFrame:
    """Overlay boxes (x, y, w, h, font_size; y down) of words (x0, y0, x1, y1) as shown on a page turned by ``rotation``: eight points at least, the font 0.8 of the height and six at least, placed by their centre in the page's own frame."""
    w, h = F.greatest(F.lit(8.0), F.col("x1") - F.col("x0")), F.greatest(F.lit(8.0), F.col("y1") - F.col("y0"))
    cx, cy = to_content_point(F.col("x0") + w / 2, F.col("y0") + h / 2, F.lit(page_width), F.lit(page_height), F.col("rotation"))
    return words.withColumns({"x": cx - w / 2, "y": cy - h / 2, "w": w, "h": h, "font_size": F.greatest(F.lit(6), F.floor(0.8 * h + 0.5)).cast("int")})
