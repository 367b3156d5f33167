"""Numeric functions: weighted sums, rounding, bands, units, bins, tiered pay."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col, ratio

# Conversions used by the analyses.
MS_PER_MINUTE = 60000.0
SQ_METRES_PER_SQ_MILE = 2.59e6
CENTS_PER_KWH_TO_DOLLARS_PER_MWH = 10.0


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Sum of column times weight. A NULL column makes the sum NULL, even at weight 0."""
    return F.expr(" + ".join(f"`{c}` * CAST({float(w)!r} AS DOUBLE)" for c, w in weights.items()))


def row_sum(cols: Iterable[str]) -> Column:
    """Sum over columns of one row, NULL counted as 0."""
    return F.expr(" + ".join(f"coalesce(`{c}`, 0D)" for c in cols))


def round_even(c: Column | str, digits: int = 0) -> Column:
    """Round half to even."""
    return F.bround(as_col(c), digits)


def band(c: Column | str, width: int) -> Column:
    """Lower end of the band of ``width`` a number is in; floors below zero too."""
    return (F.floor(as_col(c) / F.lit(width)) * F.lit(width)).cast("long")


def decade(c: Column | str) -> Column:
    return band(c, 10)


def ms_to_minutes(c: Column | str) -> Column:
    return as_col(c) / F.lit(MS_PER_MINUTE)


def square_miles(c: Column | str) -> Column:
    return as_col(c) / F.lit(SQ_METRES_PER_SQ_MILE)


def share_shift(part_new, all_new, part_old, all_old) -> Column:
    return ratio(part_new, all_new) - ratio(part_old, all_old)


def bin_index(c: Column | str, width: Column | float, boundary: Column | float = None) -> Column:
    """Index of the right-closed bin ``(boundary+(i-1)*width, boundary+i*width]``.

    The default boundary, half a width, centres the bins on multiples of the width.
    Positions are rounded first, so that a value on an edge stays in the lower bin.
    """
    width = width if isinstance(width, Column) else F.lit(float(width))
    if boundary is None:
        boundary = width / 2
    elif not isinstance(boundary, Column):
        boundary = F.lit(float(boundary))
    return F.ceil(F.round((as_col(c) - boundary) / width, 9)).cast("long")


def tiered_pay(base, hours, overtime, exempt: Column) -> Column:
    """Yearly pay of one record.

    An exempt post gets its base; a base under 100 is an hourly rate with
    time-and-a-half overtime; any other base is a yearly salary for 260 days of
    7.5 hours, paid for the hours worked.
    """
    base, hours, overtime = as_col(base), as_col(hours), as_col(overtime)
    return (
        F.when(exempt, base)
        .when(base < 100, base * (hours + overtime * 1.5))
        .when(base >= 100, (base / 260) * (hours / 7.5))
    )
