"""Ratios in double precision.

``pct_of`` multiplies first and ``pct_ratio`` divides first. Both exist because rounding to two
digits can tell them apart (23 of 160 is 14.38 one way and 14.37 the other), and every report
keeps the order it is defined with. A zero denominator gives null instead of a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rounded(value: Column, digits: int | None) -> Column:
    return value if digits is None else F.round(value, digits)


def pct_of(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part * 100 / whole``."""
    return _rounded(F.try_divide(part * F.lit(100.0), whole.cast("double")), digits)


def pct_ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """``part / whole * 100``."""
    return _rounded(
        F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), digits
    )


def per_unit(amount: Column, units: Column, digits: int | None = None) -> Column:
    """``amount / units``."""
    return _rounded(F.try_divide(amount.cast("double"), units.cast("double")), digits)
