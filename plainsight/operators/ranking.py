"""Ranking, top-n with and without ties, numbering, first rows, samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType

from ..functions.conditions import rank_of
from ..functions.missing import as_col, asc, desc
from ..session import stored
from .joins import join


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order (``TakeOrderedAndProject``)."""
    return df.orderBy(*order).limit(n)


def top_n_ties(df: DataFrame, value: Column | str, n: int, largest: bool = True) -> DataFrame:
    """The n best rows and all that tie with the last of them.

    The n-th value comes from a distributed top-n and is read as a scalar, so
    no window pulls the whole table into one task. Missing values join in only
    when there are fewer than n others.
    """
    v = as_col(value)
    best = df.select(v.alias("_v")).orderBy(desc("_v") if largest else asc("_v")).limit(n)
    last = F.min("_v") if largest else F.max("_v")
    edge = best.agg(F.struct(last.alias("last"), F.count("_v").alias("known"))).scalar()
    inside = v >= edge["last"] if largest else v <= edge["last"]
    return df.where(F.coalesce(inside, edge["known"] < n))


def top_per_group(df: DataFrame, groups: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; each task keeps n per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _first_values(counts: DataFrame, n: int, largest: bool) -> DataFrame:
    """Of sorted (group, value, count) rows, per task and group those with fewer than n counted before them.

    Rows come in order of the group's hashes and the value, so a task holds one batch
    and what it has counted of the last group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, size = (batch.column(c).to_numpy() for c in ("_h1", "_h2", "_n"))
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last != (h1[0], h2[0])
            before = np.cumsum(size) - size
            starts = np.flatnonzero(new)
            base = np.zeros(len(h1), np.int64)
            base[starts] = before[starts]
            before = before - np.maximum.accumulate(base)
            # Rows that go on with the group of the batch before.
            before[: starts[0] if len(starts) else len(h1)] += held
            last, held = (h1[-1], h2[-1]), before[-1] + size[-1]
            yield batch.filter(pa.array(before < n))

    order = F.col("_v").desc_nulls_last() if largest else F.col("_v").asc_nulls_last()
    return counts.sortWithinPartitions("_h1", "_h2", order).mapInArrow(run, counts.schema)


def top_per_group_ties(df: DataFrame, groups: Sequence[str], value: str, n: int, largest: bool = True) -> DataFrame:
    """The n best rows of each group and all that tie with the last of them; missing values come last.

    Rows are counted by (group, value), partly before the shuffle, so ties of a hot group
    are one row. Each task keeps the values that hold its first n rows of a group, and
    those of all tasks, n each at most, are merged the same way. The rows with the values
    that remain are found by a join that AQE splits: no task holds a group.
    """
    v = as_col(value)
    missing = F.isnan(v) if isinstance(df.schema[value].dataType, (FloatType, DoubleType)) else F.lit(False)
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.when(~missing, v).alias("_v"))
    # NULL adds nothing to a hash, so say where it stands.
    told = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    counts = rows.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    counts = counts.select("*", F.xxhash64(F.lit(0), *told).alias("_h1"), F.xxhash64(F.lit(1), *told).alias("_h2"))
    merged = _first_values(counts, n, largest).repartition("_h1", "_h2")
    kept = stored(_first_values(merged, n, largest).select(*keys, "_v"), "first-values")
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys)]
    return df.join(kept, [*same, F.when(~missing, v).eqNullSafe(F.col("_v"))], "left_semi")


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One whole row per key, the first of a total order."""
    return top_per_group(df, keys, 1, *order)


def number_rows(df: DataFrame, *order: Column, name: str = "row_no") -> DataFrame:
    """Number all rows of a table in a total order, from 1.

    Rows are range-partitioned and sorted in place, then kept; each row's
    number is its position plus the size of the partitions before it.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(placed.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, position = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_size")
    offsets = sizes.select("_part", before.alias("_before"))
    return (
        placed.withColumn("_in", part)
        .join(F.broadcast(offsets), F.col("_in") == F.col("_part"))
        .withColumn(name, F.col("_before") + position + 1)
        .drop("_id", "_in", "_part", "_before")
    )


def factor_codes(df: DataFrame, col: str, name: str, levels: Sequence[str] | None = None) -> DataFrame:
    """Number a column's values as the levels of a factor, from 1.

    Without ``levels`` these are all distinct values in ascending order, numbered by
    their place in range partitions, so no task holds them all; with it, values that are
    no level are NULL. Missing values are NULL in both.
    """
    if levels is not None:
        return df.withColumn(name, rank_of(col, levels).cast("long"))
    known = df.select(F.col(col).alias("_level")).where(F.col("_level").isNotNull()).distinct()
    codes = number_rows(known, F.asc("_level"), name="_code").select("_level", F.col("_code").alias(name))
    return join(df, codes, {col: "_level"}, "left", few=True)


def number_in_group(df: DataFrame, groups: Sequence[str], *order: Column, name: str = "row_no") -> DataFrame:
    """Number the rows inside each group in a total order, from 1.

    Groups of any size: rows are range-partitioned by (group, order) and
    numbered as a whole; a group's numbers start at its own lowest one.
    """
    numbered = number_rows(df, *[asc(g) for g in groups], *order, name="_global")
    starts = numbered.groupBy(*groups).agg(F.min("_global").alias("_start"))
    starts = starts.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return (
        numbered.join(starts, same)
        .withColumn(name, F.col("_global") - F.col("_start") + 1)
        .drop("_global", "_start", *[f"_g_{g}" for g in groups])
    )


def _key_text(df: DataFrame, key: str) -> Column:
    """A key as text that does not depend on its type: 7 as a long, a double and a decimal is "7"."""
    c, kind = F.col(key), df.schema[key].dataType
    if isinstance(kind, (FloatType, DoubleType, DecimalType)):
        exact = c.cast(DoubleType()) if isinstance(kind, FloatType) else c
        refused = F.raise_error(F.concat(F.lit(f"{key} is no whole number: "), c.cast("string"))).cast("string")
        whole = exact.cast(DecimalType(38, 0))
        return F.when(c.isNull() | (exact == F.floor(exact)), whole.cast("string")).otherwise(refused)
    return c.cast("string")


def sample_n(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A reproducible random sample of n rows, by the hash of a unique key.

    Whole numbers hash alike whatever their type. Doubles and decimals with a fraction,
    whose text differs between engines, are refused, as are infinite ones and NaN.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[_key_text(df, k) for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)
