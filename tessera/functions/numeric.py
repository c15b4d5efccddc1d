"""Engine-stable rounding of means."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean_rounded(col: str, digits: int, unit_digits: int) -> Column:
    """avg(col) rounded to ``digits`` decimals, for values that have ``unit_digits`` decimals.

    The mean is taken over integers (values scaled by 10^unit_digits), so a
    half-way mean is an exact binary value and every engine rounds it the
    same way (half away from zero).
    """
    units = F.round(F.col(col) * (10 ** unit_digits)).cast("long")
    return F.round(F.avg(units) * (10 ** (digits - unit_digits))) / float(10 ** digits)


def ratio_rounded(num: Column, den: Column, digits: int) -> Column:
    """num / den rounded to ``digits`` decimals as round(num * 10^digits / den) / 10^digits.

    For integer-valued num and den a half-way result is an exact binary value,
    so every engine rounds it the same way.
    """
    scale = float(10 ** digits)
    return F.round(num.cast("double") * F.lit(scale) / den.cast("double")) / F.lit(scale)
