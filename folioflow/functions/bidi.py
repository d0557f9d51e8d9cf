"""Text in visual order as it is read."""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Right-to-left letters: Hebrew, Arabic and their presentation forms.
RIGHT_TO_LEFT = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
_PAIRS = "()[]{}<>«»‹›"
_MIRROR = str.maketrans(dict(zip(_PAIRS, "".join(b + a for a, b in zip(_PAIRS[::2], _PAIRS[1::2], strict=True)), strict=True)))


def _strong(c: str) -> bool:
    return unicodedata.bidirectional(c) in ("L", "EN", "AN")


@functools.lru_cache(maxsize=1 << 16)
def logical(text: str | None) -> str | None:
    """The reading order of a string stored in visual order: right-to-left text is turned round and normalised, left-to-right spans inside it stay as they are, brackets outside of them are mirrored."""
    if text is None or not any(unicodedata.bidirectional(c) in ("R", "AL") for c in text):
        return text
    if not any(map(_strong, text)):
        return unicodedata.normalize("NFKC", text[::-1])
    turned = text[::-1]
    # a span begins and ends with a strong character; neutral ones inside belong to it
    kinds = "".join("s" if _strong(c) else "r" if unicodedata.bidirectional(c) in ("R", "AL", "NSM") else "n" for c in turned)
    out, at = [], 0
    for m in re.finditer("s(?:[sn]*s)?", kinds):
        out += [turned[at : m.start()].translate(_MIRROR), turned[m.start() : m.end()][::-1]]
        at = m.end()
    return unicodedata.normalize("NFKC", "".join(out) + turned[at:].translate(_MIRROR))


def logical_text(c: Column) -> Column:
    """Strings in visual order as they are read; only those with right-to-left letters go through Python."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(logical)

    return F.when(c.rlike(RIGHT_TO_LEFT), read(F.when(c.rlike(RIGHT_TO_LEFT), c))).otherwise(c)


def normalized(c: Column) -> Column:
    """Compatibility normal form; only strings with a sign beyond ASCII go through Python."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))

    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, fold(F.when(wide, c))).otherwise(c)


def normalized_all(words: Column) -> Column:
    """As :func:`normalized`, of each string of an array: a row's strings go through Python together, and rows without a sign beyond ASCII not at all."""

    @F.pandas_udf("array<string>")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: ts if ts is None else [t if t is None else unicodedata.normalize("NFKC", t) for t in ts])

    wide = F.exists(words, lambda t: F.coalesce(t.rlike(r"[^\x00-\x7F]"), F.lit(False)))
    return F.when(wide, fold(F.when(wide, words))).otherwise(words)
