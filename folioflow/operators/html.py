"""HTML sanitation: flat rules as expressions, tree rules by the standard parser inside Arrow batches."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioflow.functions.text import allowed_scheme

#: Elements that go with their content, and style properties that stay.
DROPPED = {"xml", "style", "meta", "link", "title", "script"}
STYLES = {"font-weight", "font-style", "text-decoration", "color", "text-align"}
_VOID = {"br", "img", "hr", "input", "meta", "link", "col", "wbr"}
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Cleaner(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in DROPPED:
            if tag not in _VOID:
                self.inside.append(tag)
            return
        if self.inside or ":" in tag:
            return
        kept = []
        for name, value in attrs:
            value = value or ""
            if name in ("class", "lang") or name.startswith("on"):
                continue
            if name == "style":
                parts = [p.strip() for p in value.split(";") if p.split(":")[0].strip().lower() in STYLES]
                value = "; ".join(parts)
                if not value:
                    continue
            if name == "href" and not re.match(r"(?i)(?:https?:|mailto:|[^:]*$)", re.sub(r"[\x00-\x1f]", "", value).strip()):
                continue
            if tag == "img" and name == "src" and not (re.match(r"(?i)https?:", value) or (len(value) <= 5_000_000 and re.match(r"(?i)data:image/(?:png|jpeg|gif|webp);", value))):
                return
            kept.append(f' {name}="{escape(value)}"')
        self.out.append(f"<{tag}{''.join(kept)}>")

    def handle_endtag(self, tag: str) -> None:
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()
        elif not self.inside and tag not in DROPPED and ":" not in tag and tag not in _VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(escape(data.replace(" ", " "), quote=False))


def cleaned(html: str | None) -> str | None:
    if html is None:
        return None
    c = _Cleaner()
    c.feed(html)
    c.close()
    text, before = "".join(c.out), None
    empty = re.compile(r"<(" + "|".join(sorted(_BLOCKS)) + r")(?:\s[^<>]*)?>\s*</\1>")
    while text != before:
        before, text = text, empty.sub("", text)
    return text


@F.pandas_udf(StringType())
def _clean(s: pd.Series) -> pd.Series:
    return s.map(cleaned)


def clean_html(df: DataFrame, col: str = "html") -> DataFrame:
    """page_id, cleaned: comments go as an expression, then elements, attributes, links, images and empty blocks by tree."""
    bare = F.regexp_replace(F.col(col), r"(?s)<!--.*?-->", "")
    return df.select("page_id", _clean(bare).alias("cleaned"))


def page_links(df: DataFrame, col: str = "html") -> DataFrame:
    """page_id, href of the links whose scheme is allowed."""
    hrefs = df.select("page_id", F.explode(F.regexp_extract_all(F.col(col), F.lit(r'href="([^"]*)"'), F.lit(1))).alias("href"))
    return hrefs.where(allowed_scheme(F.col("href")))
