"""Ratios and the two rounding rules: ``F.round`` goes half away from zero, ``F.bround`` half to even."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fill_rate(filled: Column, total: Column) -> Column:
    """Percent filled, 0 when there is nothing to fill."""
    return F.coalesce(F.try_divide(filled.cast("double"), total.cast("double")) * 100, F.lit(0.0))


def share(part: Column, total: Column, digits: int = 1) -> Column:
    """Percent of a total, half-even."""
    return F.bround(F.try_divide(part.cast("double"), total.cast("double")) * 100, digits)


def mean_money(total: Column, n: Column, digits: int = 2) -> Column:
    """Mean of exact amounts, half-even, from their sum and non-null count."""
    return F.bround(F.try_divide(total, n), digits)
