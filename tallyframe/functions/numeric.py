"""Numeric column helpers.

All of them are plain Catalyst expressions (whole-stage codegen friendly).
pandas ``round`` is half-even, so 1-dp outputs use ``bround``; ANSI mode is
on, so divisions go through ``try_divide``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_even(c, digits: int = 1) -> Column:
    return F.bround(col_(c), digits)


def js_round(c) -> Column:
    """JavaScript ``Math.round``: floor(x + 0.5)."""
    return F.floor(col_(c) + F.lit(0.5))


def nan_to_null(c) -> Column:
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def safe_div(a, b) -> Column:
    """a / b with null instead of an error when b is 0 or null."""
    return F.try_divide(col_(a).cast("double"), col_(b).cast("double"))


def clip(c, lo, hi) -> Column:
    """pandas ``clip``: null stays null (``greatest``/``least`` would skip it)."""
    c = col_(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def min_max_scale(c, lo, hi) -> Column:
    """Scale to 0-100 given the column's min ``lo`` and max ``hi``; constant -> 50."""
    c, lo, hi = col_(c), col_(lo), col_(hi)
    return F.when(hi == lo, F.lit(50.0)).otherwise((c - lo) / (hi - lo) * F.lit(100.0))


def weighted_sum(pairs) -> Column:
    """Left-to-right sum of w*c (same association order as the pandas source)."""
    total = None
    for w, c in pairs:
        term = F.lit(float(w)) * col_(c)
        total = term if total is None else total + term
    return total
