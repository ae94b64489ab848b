"""Column helpers that keep a missing value missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """True where ``x`` is present, not NaN and not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def present(x: Column) -> Column:
    """``x`` with NaN turned into null."""
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where the divisor is zero or either side is missing."""
    return a / F.nullif(b, F.lit(0.0))


def clip(x: Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Bound ``x``; unlike ``greatest``/``least`` a missing ``x`` stays missing."""
    y = x
    if low is not None:
        y = F.greatest(y, low if isinstance(low, Column) else F.lit(float(low)))
    if high is not None:
        y = F.least(y, high if isinstance(high, Column) else F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def positive_log(x: Column) -> Column:
    """Natural logarithm; null unless ``x`` is above zero."""
    return F.when(x > 0, F.ln(x))
