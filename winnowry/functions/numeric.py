"""Exact two-decimal rounding."""

from pyspark.sql import Column, functions as F


def round2(x: Column) -> Column:
    """Nearest two-decimal value of a double, judged on its exact binary value, ties to even.

    Rounding a double through its printed digits moves values such as 0.285 the wrong way. Here the
    rounding error of ``x * 100`` is recovered with a split product and decides the one case, a
    fraction of exactly one half, in which the product itself cannot.
    """
    y = x * 100.0
    wide = x * 134217729.0
    high = wide - (wide - x)
    error = (high * 100.0 - y) + (x - high) * 100.0
    floor = F.floor(y).cast("double")
    fraction = y - floor
    odd = F.pmod(floor, F.lit(2.0)) == 1.0
    up = (fraction > 0.5) | ((fraction == 0.5) & ((error > 0) | ((error == 0) & odd)))
    return F.when(up, floor + 1.0).otherwise(floor) / 100.0
