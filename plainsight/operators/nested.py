"""Nested records, delimited lists and arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import as_col
from ..functions.text import clean_list_item


def rectangle(df: DataFrame, outer: str, parent: Sequence[str], inner: str, position: str = "position") -> DataFrame:
    """Rows for every element of an array nested in an array of structs.

    Parent fields and the 1-based position are kept; parents whose inner array
    is missing or empty, and NULL elements, give no row.
    """
    # The outer forms keep Catalyst from evaluating the arrays once more in filters.
    parents = df.select(F.explode_outer(outer).alias("_p"))
    present = F.filter(F.col(f"_p.{inner}"), lambda x: x.isNotNull())
    # The array gets a column of its own, so that it is not copied into every row it gives.
    arrays = parents.select(*[F.col(f"_p.{c}").alias(c) for c in parent], present.alias("_items"))
    items = arrays.select(*parent, F.posexplode_outer("_items").alias("_pos", "_item")).where(F.col("_pos").isNotNull())
    return items.select(*parent, (F.col("_pos") + 1).alias(position), "_item.*")


def explode_delimited(df: DataFrame, col: str, sep: str, name: str | None = None) -> DataFrame:
    """One row per piece of a delimited text."""
    name = name or col
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.split(F.col(col), "\\Q" + sep + "\\E")).alias(name))


def explode_names(df: DataFrame, col: str, name: str) -> DataFrame:
    """One row per name of a list kept as text like ``['A', 'B']``; the list is dropped."""
    pieces = explode_delimited(df, col, ",", "_piece").drop(col)
    return pieces.withColumn(name, clean_list_item("_piece")).drop("_piece")


def contains(array: Column | str, value: Column | str) -> Column:
    return F.coalesce(F.array_contains(as_col(array), as_col(value)), F.lit(False))


def fields(array: Column | str, field: str) -> Column:
    """One field of every struct in an array."""
    return F.transform(as_col(array), lambda x: x[field])
