"""Null, NaN and zero rules as column expressions.

Spark's ``sum``/``avg``/``percentile`` propagate NaN and ANSI mode raises on a
zero divisor, so every rule is spelled out here once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0.0))


def nan_to_null(c: Column | str) -> Column:
    """NaN means "missing" in the inputs; NULL is what Spark aggregates skip."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def lenient_double(c: Column | str) -> Column:
    """Numeric value of ``c``; text that is no number, and NaN, become NULL."""
    return nan_to_null(as_col(c).try_cast("double"))


def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` where ``den > 0``, else 0."""
    num, den = as_col(num), as_col(den)
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def ratio_nonzero(num: Column | str, den: Column | str) -> Column:
    """``num / den`` where ``den`` is not 0, else 0."""
    num, den = as_col(num), as_col(den)
    return F.when(den != 0, F.try_divide(num, den)).otherwise(F.lit(0.0))


def floor_zero(c: Column | str) -> Column:
    """``max(c, 0)``; NULL counts as 0."""
    return F.greatest(zero_if_null(c), F.lit(0.0))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """``c`` limited to ``[low, high]``; NULL stays NULL."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high))))


def percent(num: Column | str, den: Column | str) -> Column:
    return F.lit(100.0) * ratio(num, den)
