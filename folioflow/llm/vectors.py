"""Integer vectors from arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column, scale: int, bits: int) -> Column:
    """Whether there is a vector, no component of which is null, not finite or, scaled, 2**bits or more in size."""
    limit = float(1 << bits) / scale
    # NaN is greater than any number; what is null is not less
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < limit, F.lit(False))), F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component of a usable vector."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("int"))
