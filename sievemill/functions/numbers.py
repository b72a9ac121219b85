"""Numbers with Python's semantics."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(x: Column, digits: int = 3) -> Column:
    """A double from 0 to 1, rounded as Python's round does: by its exact binary value, ties to the even digit."""
    whole = F.lit(str(1 << 63)).cast("decimal(20,0)")
    scaled = (x * float(1 << 63)).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(8,0)")
    low, rest = F.call_function("div", scaled, whole), F.pmod(scaled, whole) * F.lit(2).cast("decimal(1,0)")
    up = (rest > whole) | ((rest == whole) & (low % 2 == 1))
    return F.when(x >= 1, F.lit(1.0)).otherwise((low + up.cast("long")).cast("double") / float(10**digits))
