"""Pivots in both directions, and stacking of tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_wider(df: DataFrame, ids: Sequence[str], names: str, values: Mapping[object, str], agg: Column) -> DataFrame:
    """One column per listed value of ``names``, named by the mapping."""
    wide = df.groupBy(*ids).pivot(names, list(values)).agg(agg)
    return wide.withColumnsRenamed({str(k): v for k, v in values.items()})


def pivot_longer(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str, dtype: str = "double") -> DataFrame:
    """One row per id and column, the values cast to one type."""
    cast = df.select(*ids, *[F.col(c).cast(dtype).alias(c) for c in values])
    return cast.unpivot(list(ids), list(values), name, value)


def stack(*frames: DataFrame) -> DataFrame:
    """Union of rows by column name; columns absent from a table become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def set_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)
