"""Compute a value once and use it many times in one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with the value bound to a lambda variable.

    Catalyst puts a column's expression wherever the column is used, so a split text
    that a ``transform`` looks into would be split again for every element.
    """
    return F.transform(F.array(value), f)[0]
