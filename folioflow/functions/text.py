"""Column helpers over strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Latin ligatures of Unicode's presentation forms and their letters.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
#: Blocks of Arabic letters.
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
#: Bullets that begin a list item.
BULLETS = "•◦▪●○→►▸-"


def fold_ligatures(c: Column) -> Column:
    for sign, letters in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return c


def is_arabic(c: Column) -> Column:
    return c.rlike(ARABIC)


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def title_case(c: Column) -> Column:
    """Upper case for the first character of each space-parted token; the rest stays."""
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.char_length(t)))), " ")


def line_markers(c: Column, ordered: bool) -> Column:
    """A bullet or a running number before each line that is not empty."""
    lines = F.split(c, "\n")
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, line: Column) -> Column:
        n = F.when(line == "", s["n"]).otherwise(s["n"] + 1)
        mark = F.concat(n.cast("string"), F.lit(". ")) if ordered else F.lit("• ")
        return F.struct(n.alias("n"), F.concat(s["out"], F.array(F.when(line == "", line).otherwise(F.concat(mark, line)))).alias("out"))

    return F.aggregate(lines, zero, step, lambda s: F.array_join(s["out"], "\n"))


def clean_link(c: Column) -> Column:
    """http, https and mailto links; a bare name with a dot becomes https; null else."""
    t = F.trim(c)
    return F.when(t.rlike(r"(?i)^(?:https?|mailto):"), t).when(t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None).when(t.rlike(r"^[^\s]+\.[^\s]+$"), F.concat(F.lit("https://"), t))


def allowed_scheme(c: Column) -> Column:
    """Whether a URL has no scheme or one of http, https and mailto, control characters aside."""
    t = F.trim(F.regexp_replace(c, r"[\x00-\x1F]", ""))
    scheme = F.lower(F.regexp_extract(t, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return scheme.isin("", "http", "https", "mailto")


def encode_link(c: Column) -> Column:
    """Parentheses, angle brackets and blanks as percent codes."""
    for sign, code in (("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), (" ", "%20"), ("\t", "%09"), ("\n", "%0A")):
        c = F.replace(c, F.lit(sign), F.lit(code))
    return c


def hex_color(kind: Column, v: list[Column]) -> Column:
    """Six hex digits of a gray, rgb or cmyk colour with parts from 0 to 1."""
    part = lambda x: F.lpad(F.lower(F.hex(F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) * 255 + 0.5).cast("int"))), 2, "0")
    rgb = F.concat(*[part(x) for x in v[:3]])
    gray = F.concat(part(v[0]), part(v[0]), part(v[0]))
    cmyk = F.concat(*[part((1 - x) * (1 - v[3])) for x in v[:3]])
    return F.when(kind == "gray", gray).when(kind == "cmyk", cmyk).otherwise(rgb)


def expand_hex(c: Column) -> Column:
    """#abc as aabbcc, #aabbcc as aabbcc, null else."""
    t = F.lower(F.regexp_extract(c, r"^#?([0-9a-fA-F]{3}|[0-9a-fA-F]{6})$", 1))
    return F.when(F.char_length(t) == 3, F.regexp_replace(t, "(.)", "$1$1")).when(F.char_length(t) == 6, t)


def list_prefix(c: Column) -> Column:
    """struct<kind, marker, form, rest> of a list item, or null; bullets, decimals, letters and roman numerals of both cases.

    A mark stands at the very beginning and is followed by a blank. Numbers may be followed by a dot or a closing
    bracket or stand in two brackets; letters need a bracket, and make a roman numeral only if there are two or
    more. form shows how the number is written: ``%1.``, ``%1)`` or ``(%1)``.
    """
    part = lambda pattern: F.regexp_extract(c, pattern, 1)
    dotted, closed, both = part(r"^([0-9]+)\.\s"), part(r"^([0-9]+|[a-zA-Z]+)\)\s"), part(r"^\(([0-9]+|[a-zA-Z]+)\)\s")
    marker = F.concat(dotted, closed, both)  # one of them at most is there
    one = F.char_length(marker) == 1
    kind = (
        F.when(c.rlike(rf"^[{BULLETS}]\s"), "bullet")
        .when(marker.rlike("^[0-9]+$"), "decimal")
        .when(one & marker.rlike("[a-z]"), "lower")
        .when(one & marker.rlike("[A-Z]"), "upper")
        .when(is_roman(F.lower(marker)), F.when(marker == F.upper(marker), "upper_roman").otherwise("roman"))
    )
    form = F.when(dotted != "", "%1.").when(closed != "", "%1)").when(both != "", "(%1)")
    rest = F.regexp_replace(c, r"^\S+\s+", "")
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.when(kind != "bullet", marker).alias("marker"), F.when(kind != "bullet", form).alias("form"), rest.alias("rest")))


def roman(n: Column) -> Column:
    """Lower-case roman numeral of a positive integer; thousands are repeated as often as it takes."""
    digit = lambda unit, one, five, ten: F.get(F.array(*[F.lit(s) for s in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), F.pmod(F.floor(n / unit), F.lit(10)).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), digit(100, "c", "d", "m"), digit(10, "x", "l", "c"), digit(1, "i", "v", "x"))


def is_roman(c: Column) -> Column:
    """Whether lower-case letters are the numeral of their own value, below 4000."""
    value = F.create_map(*[F.lit(x) for pair in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100), ("d", 500), ("m", 1000)) for x in pair])
    # from the right: a letter that is worth less than the one after it counts against it
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    total = F.aggregate(F.reverse(F.split(c, "")), zero, lambda s, ch: F.struct((s["sum"] + F.when(F.coalesce(value[ch], F.lit(0)) < s["last"], -1).otherwise(1) * F.coalesce(value[ch], F.lit(0))).alias("sum"), F.coalesce(value[ch], F.lit(0)).alias("last")), lambda s: s["sum"])
    return F.when(c.rlike("^[ivxlcdm]{1,15}$"), total.between(1, 3999) & (roman(total) == c)).otherwise(False)


def letters_of(n: Column) -> Column:
    """a, b, ... z, aa, ab, ... of a positive integer."""
    zero = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))

    def step(s: Column, _: Column) -> Column:
        more = s["left"] > 0
        return F.struct(F.when(more, F.floor((s["left"] - 1) / 26)).otherwise(s["left"]).alias("left"), F.when(more, F.concat(F.char(97 + F.pmod(s["left"] - 1, F.lit(26)).cast("int")), s["out"])).otherwise(s["out"]).alias("out"))

    # fourteen letters hold every long
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), zero, step, lambda s: s["out"])
