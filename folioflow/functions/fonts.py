"""Font names to style, family and a canonical name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def font_style(df: DataFrame) -> DataFrame:
    """Adds base (without the subset tag), bold, italic and family (serif, sans, mono) to a font column."""
    base = F.regexp_replace("font", r"^[A-Z]{6}\+", "")
    low = F.lower(base)
    family = F.when(low.rlike("mono|courier|console|typewriter"), "mono").when(low.rlike("sans|arial|helvet|verdana|calibri|gothic"), "sans").otherwise("serif")
    return df.withColumns({"base": base, "bold": low.rlike("bold|black|heavy|semibold|demi"), "italic": low.rlike("italic|oblique"), "family": family})


#: Shapes of names that a program made up.
GENERATED = (r"^TT[0-9A-F]+o[0-9]+$", r"^[A-Za-z]{1,7}[0-9]{1,4}$", r"^LM[A-Z][A-Za-z]*[0-9]+$", r"^[0-9A-Fa-f]{8,}$", r"(?i)^(?:Font|CIDFont|Identity)")
#: What foundries put before and after a family's name, and regions at its end.
FOUNDRY, REGION = r"^itc|(?:ltstd|ltpro|std|lt)$", r"CJK(jp|kr|sc|tc|hk)$"


def normalize_fonts(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds name and passed: the canonical name from a mapping (key, canonical) by spaceless key, as it is or without what a foundry adds; the generic family for generated names and such as are no words; else, passed, the name with spaces.

    What follows the first hyphen or comma, and PS and MT at the end, are no part of a name. A space comes before
    a capital that begins a word of three letters, after a small letter, or one of four, after a capital.
    """
    styled = font_style(df)
    plain = F.trim(F.regexp_replace(F.regexp_replace("base", r"[-,].*$", ""), r"(?:(?:PS)?MT|PS)$", ""))
    keyed = styled.withColumn("plain", plain).withColumn("look", F.lower(F.regexp_replace("plain", r"\s", "")))
    keyed = keyed.withColumn("bare", F.regexp_replace("look", FOUNDRY, ""))
    known = lambda c: mapping.select(F.col("key").alias(f"{c}_key"), F.col("canonical").alias(f"{c}_name"))
    j = keyed.join(known("look"), F.col("look") == F.col("look_key"), "left").join(known("bare"), F.col("bare") == F.col("bare_key"), "left")
    canonical = F.coalesce("look_name", "bare_name")
    made_up = ~F.col("plain").rlike("^[A-Za-z][A-Za-z0-9 ]*$")
    for shape in GENERATED:
        made_up = made_up | F.col("plain").rlike(shape)
    spaced = F.regexp_replace("plain", r"([a-z])(?=[A-Z](?:[a-z]{2}|[A-Z]{2}))", "$1 ")
    spaced = F.regexp_replace(spaced, r"([A-Z])(?=[A-Z][a-z]{3})", "$1 ")
    spaced = F.concat(F.regexp_replace(spaced, REGION, "CJK "), F.upper(F.regexp_extract(spaced, REGION, 1)))
    name = F.coalesce(canonical, F.when(made_up, F.col("family")).otherwise(spaced))
    return j.withColumn("name", name).withColumn("passed", canonical.isNull() & ~made_up).drop("plain", "look", "bare", "look_key", "look_name", "bare_key", "bare_name")
