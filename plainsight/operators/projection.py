"""Projections: selecting, renaming, deriving and tagging columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def select_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name matches a regex, in their order."""
    return df.select([c for c in df.columns if re.search(pattern, c)])


def derive(df: DataFrame, **steps: Column) -> DataFrame:
    """Add columns one after the other, so that later ones may use earlier ones."""
    for name, value in steps.items():
        df = df.withColumn(name, value)
    return df


def numeric_columns(df: DataFrame, but: Iterable[str] = ()) -> list[str]:
    skip = set(but)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def map_columns(df: DataFrame, f: Callable[[Column], Column], only: Iterable[str] | None = None, but: Iterable[str] = ()) -> DataFrame:
    """Apply one function to a set of columns in a single projection."""
    chosen = set(df.columns if only is None else only) - set(but)
    return df.select([f(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns])


def as_text(df: DataFrame) -> DataFrame:
    return map_columns(df, lambda c: c.cast("string"))


def clean_names(df: DataFrame) -> DataFrame:
    """Rename all columns to unique snake-case names."""
    return df.toDF(*text.clean_names(df.columns))


def tag(df: DataFrame, **constants) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in constants.items()})


def record_of(df: DataFrame, entity: Sequence[str], key: str, fields: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """Key/value rows to one wide record per entity.

    ``fields`` maps an output name to the key to look for and the value to take.
    """
    return df.groupBy(*entity).agg(
        *[F.max(F.when(F.col(key) == label, value)).alias(name) for name, (label, value) in fields.items()]
    )


def drop_first_per_group(df: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    """Drop the row with the lowest ordinal of each group.

    The ordinal must be unique in its group. One aggregated minimum per group
    is joined back, so no group is ever sorted or held whole.
    """
    first = df.groupBy(*groups).agg(F.min(order).alias("_first"))
    first = first.withColumnsRenamed({g: f"_{g}" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    same.append(F.col(order) == F.col("_first"))
    return df.join(first, same, "left_anti")


def nth_in_group(groups: Sequence[str], order: Sequence[Column], name: str = "row_no"):
    """``row_number`` inside a group, as a (name, column) pair for ``withColumn``."""
    return name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
