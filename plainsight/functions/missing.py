"""Missing values, division by zero, and order of missing values.

NaN counts as missing, sums over nothing are 0, strict aggregates turn NULL as
soon as one input is missing, and sorts put missing values last both ways.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_missing(c: Column | str) -> Column:
    """NULL or NaN of a double column."""
    c = as_col(c)
    return c.isNull() | F.isnan(c)


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def sum0(c: Column | str) -> Column:
    """Sum that skips NULL and is 0.0 over nothing."""
    return F.coalesce(F.sum(as_col(c)), F.lit(0.0))


def strict(aggregate, c: Column | str) -> Column:
    """``aggregate(c)``, NULL if any value of ``c`` is NULL."""
    c = as_col(c)
    return F.when(F.count_if(c.isNull()) == 0, aggregate(c))


def mean_strict(c: Column | str) -> Column:
    return strict(F.avg, c)


def sum_strict(c: Column | str) -> Column:
    return strict(F.sum, c)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Division where x/0 is infinite, 0/0 is NaN and NULL stays NULL."""
    num = as_col(num).cast("double")
    den = as_col(den).cast("double")
    signed = F.when(F.isnan(num) | (num == 0), F.lit(float("nan"))).otherwise(
        F.signum(num) * F.lit(float("inf"))
    )
    return (
        F.when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
        .when(den == 0, signed)
        .otherwise(F.try_divide(num, den))
    )


def is_in(c: Column | str, values: Iterable) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in(c: Column | str, values: Iterable) -> Column:
    """Negated membership that keeps NULL rows."""
    return ~is_in(c, values)


def matches(c: Column | str, pattern: str) -> Column:
    """Regex match that is never NULL."""
    return F.coalesce(as_col(c).rlike(pattern), F.lit(False))


def asc(c: Column | str) -> Column:
    return as_col(c).asc_nulls_last()


def desc(c: Column | str) -> Column:
    return as_col(c).desc_nulls_last()


def desc_missing_last(c: Column | str) -> list[Column]:
    """Descending order of a double with NULL and NaN both at the end."""
    return [is_missing(c).asc(), as_col(c).desc()]


def asc_missing_last(c: Column | str) -> list[Column]:
    return [is_missing(c).asc(), as_col(c).asc()]
