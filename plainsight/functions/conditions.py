"""Conditional functions: buckets, cuts, recodes, casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col, is_missing


def if_else(cond: Column, yes, no) -> Column:
    """Two-way choice; a NULL condition gives NULL."""
    return F.when(cond, yes).when(~cond, no)


def low_mid_high(c: Column | str, low: float, high: float, labels=("Small", "Medium", "Large"), missing="Unknown") -> Column:
    """Below ``low``, from ``low`` to ``high`` inclusive, above; missing first."""
    c = as_col(c)
    return (
        F.when(is_missing(c), missing)
        .when(c < low, labels[0])
        .when(c <= high, labels[1])
        .otherwise(labels[2])
    )


def cut_right(c: Column | str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins with the lowest break included; outside is NULL."""
    c = as_col(c)
    out = F.when(c.between(breaks[0], breaks[1]), labels[0])
    for low, high, label in zip(breaks[1:], breaks[2:], labels[1:]):
        out = out.when((c > low) & (c <= high), label)
    return out


def recode(c: Column | str, mapping: Mapping[str, str], default: str) -> Column:
    """Map codes to labels through a map literal."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    c = as_col(c)
    return F.when(c.isNull(), default).otherwise(
        F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))
    )


def rank_of(c: Column | str, levels: Sequence[str]) -> Column:
    """Position of a label in its declared order, from 1; others are NULL."""
    position = F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(c))
    return F.when(position > 0, position)
