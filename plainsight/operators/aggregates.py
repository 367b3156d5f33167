"""Aggregates that a plain ``groupBy().agg()`` does not give."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import as_col, is_missing, ratio
from ..functions.numbers import bin_index
from ..session import stored
from .joins import small
from .projection import numeric_columns


def count_values(df: DataFrame, *keys: str) -> DataFrame:
    """Number of distinct key values as ``n``; NULL counts as a value."""
    return df.select(*keys).distinct().agg(F.count("*").alias("n"))


def count_sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def join_distinct(c: Column | str, sep: str = ",") -> Column:
    """Distinct values of a group joined in order of value."""
    return F.array_join(F.array_sort(F.collect_set(as_col(c))), sep)


def weighted_mean(value: Column | str, weight: Column | str) -> Column:
    return ratio(F.sum(as_col(value) * as_col(weight)), F.sum(as_col(weight)))


def group_mode(df: DataFrame, groups: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value of a group, the lowest one on ties, with its count.

    Counts come first, so only one row per (group, value) reaches the second
    aggregate, and no window holds a whole group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*groups).agg(F.min(F.struct((-F.col("_n")).alias("minus"), F.col(value).alias("value"))).alias("_b"))
    return best.select(*groups, F.col("_b.value").alias(name), (-F.col("_b.minus")).alias("n"))


def rarest(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy("n", key).limit(1)


def sum_all_numeric(df: DataFrame, groups: Sequence[str], but: Sequence[str] = ()) -> DataFrame:
    """Sum of every numeric column of the schema per group."""
    cols = numeric_columns(df, but=[*groups, *but])
    return df.groupBy(*groups).agg(*[F.sum(c).alias(c) for c in cols])


def ratio_of_sums(df: DataFrame, groups: Sequence[str], num: Column | str, den: Column | str, name: str = "ratio") -> DataFrame:
    sums = df.groupBy(*groups).agg(F.sum(as_col(num)).alias("_num"), F.sum(as_col(den)).alias("_den"))
    return sums.select(*groups, ratio("_num", "_den").alias(name))


def mean_of_ratios(num: Column | str, den: Column | str) -> Column:
    """Mean of row ratios, rows without a number (0/0, NULL) left out."""
    r = ratio(num, den)
    return F.avg(F.when(~F.isnan(r), r))


def max_minus_constant(df: DataFrame, groups: Sequence[str], value: str, constant: str, name: str) -> DataFrame:
    """Group maximum less a value that must be the same in the whole group."""
    same = F.min(constant).eqNullSafe(F.max(constant))
    checked = F.when(same, F.max(constant)).otherwise(
        F.raise_error(F.lit(f"{constant} differs inside a group")).cast("double")
    )
    return df.groupBy(*groups).agg((F.max(value) - checked).alias(name))


def growth(df: DataFrame, period: str, value: Column, old, new) -> DataFrame:
    """Sums of two periods side by side, and the growth from old to new."""
    p = F.col(period)
    both = df.where(p.isin(old, new)).agg(
        F.coalesce(F.sum(F.when(p == old, value)), F.lit(0.0)).alias("old_total"),
        F.coalesce(F.sum(F.when(p == new, value)), F.lit(0.0)).alias("new_total"),
    )
    return both.withColumn("growth_rate", ratio(F.col("new_total") - F.col("old_total"), "old_total"))


def against_group(df: DataFrame, key: str, value: str, numerator, denominator, name: str = "ratio") -> DataFrame:
    """Attach the ratio of two named groups' mean to every row, read as a scalar."""
    k, v = F.col(key), F.col(value)
    one = df.agg(ratio(F.avg(F.when(k == numerator, v)), F.avg(F.when(k == denominator, v))).alias(name))
    return df.withColumn(name, one.scalar())


def quota_per_class(df: DataFrame, cls: str, quota: Mapping[str, int], order: Sequence[Column]) -> DataFrame:
    """The first rows of each class up to its quota, in one pass."""
    k = F.col(cls)
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(*order))
    allowed = F.coalesce(*[F.when(k == name, F.lit(n)) for name, n in quota.items()], F.lit(0))
    return (
        df.where(k.isin(list(quota)))
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= max(quota.values()))
        .where(F.col("_rank") <= allowed)
        .drop("_rank")
    )


def histogram_width(df: DataFrame, value: str, width: float, low: float | None = None, high: float | None = None, boundary: float | None = None) -> DataFrame:
    """Counts per right-closed bin of fixed width; values outside the limits are left out."""
    v = F.col(value)
    rows = df.where(~is_missing(v))
    if low is not None:
        rows = rows.where((v >= low) & (v <= high))
    return rows.groupBy(bin_index(v, width, boundary).alias("bin")).agg(F.count("*").alias("n"))


def with_stats(df: DataFrame, name: str, *stats: Column) -> DataFrame:
    """Attach aggregates of the whole table to every row, as one struct read through a single scalar."""
    return df.withColumn(name, df.agg(F.struct(*stats)).scalar())


def histogram_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts for a fixed number of bins centred on minimum, ..., maximum."""
    v = F.col(value)
    low, high = F.col("_s.low"), F.col("_s.high")
    rows = with_stats(df.where(~is_missing(v)), "_s", F.min(v).alias("low"), F.max(v).alias("high"))
    position = F.coalesce(F.round(F.try_divide(v - low, (high - low) / (bins - 1)), 9), F.lit(0.0))
    # A value on the edge of two bins goes to the lower one.
    return rows.withColumn("bin", F.ceil(position - 0.5).cast("long")).groupBy("bin").agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, facet: str, x: str, y: str, bins: tuple[int, int], free_x: bool = False, count: Column | None = None) -> DataFrame:
    """Counts per facet on a grid that spans the range of each column.

    ``free_x`` lets x span its range inside each facet. ``count`` sums a number
    of rows each row stands for.
    """
    edges = [f(c).alias(f"{c}_{f.__name__}") for c in (x, y) for f in (F.min, F.max)]
    rows = with_stats(df.where(~is_missing(x) & ~is_missing(y)), "_s", *edges)
    span = {c: (F.col(f"_s.{c}_min"), F.col(f"_s.{c}_max")) for c in (x, y)}
    if free_x:
        own = small(rows.groupBy(F.col(facet).alias("_facet")).agg(F.min(x).alias("_low"), F.max(x).alias("_high")))
        rows = rows.join(own, F.col(facet).eqNullSafe(F.col("_facet")))
        span[x] = F.col("_low"), F.col("_high")

    def cell(c: str, n: int) -> Column:
        low, high = span[c]
        share = F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))
        return F.greatest(F.ceil(F.round(share * n, 9)), F.lit(1)).cast("long")

    cells = rows.withColumns({"x_bin": cell(x, bins[0]), "y_bin": cell(y, bins[1])})
    return cells.groupBy(facet, "x_bin", "y_bin").agg((F.count("*") if count is None else F.sum(count)).alias("n"))


def _value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs in each group, as ``_v`` and ``_n``."""
    return df.where(~is_missing(value)).groupBy(*groups, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group, however large a group is."""
    return _quantiles(_ranged(_value_counts(df, groups, value), groups), groups, probs)


def _ranged(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Value counts range-partitioned by (group, value), with the partition kept as ``_part``."""
    return stored(counts.repartitionByRange(*groups, "_v").withColumn("_part", F.spark_partition_id()), "ranged")


def _quantiles(ranged: DataFrame, groups: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles from ranged value counts.

    Running counts inside each partition plus the totals of earlier partitions
    give every value its ranks, so no group has to fit one task.
    """
    parts = ranged.groupBy(*groups, "_part").agg(F.sum("_n").alias("_total"))
    every = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    parts = parts.select(
        *[F.col(g).alias(f"_g_{g}") for g in groups],
        F.col("_part").alias("_g_part"),
        (F.sum("_total").over(every.orderBy("_part")) - F.col("_total")).alias("_before"),
        F.sum("_total").over(every).alias("_all"),
    )
    same = F.col("_part") == F.col("_g_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    running = F.sum("_n").over(Window.partitionBy(*groups, "_part").orderBy("_v"))
    ranked = ranged.withColumn("_run", running).join(parts, same).withColumn("_end", F.col("_before") + F.col("_run"))

    def at(index: Column) -> Column:
        hit = (index >= F.col("_end") - F.col("_n")) & (index < F.col("_end"))
        return F.max(F.when(hit, F.col("_v")))

    picks, outs = [], []
    for name, p in probs.items():
        h = (F.col("_all") - 1) * F.lit(float(p))
        picks += [at(F.floor(h)).alias(f"_{name}_lo"), at(F.ceil(h)).alias(f"_{name}_hi"), F.max(h - F.floor(h)).alias(f"_{name}_f")]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((lo + (hi - lo) * F.col(f"_{name}_f")).alias(name))
    return ranked.groupBy(*groups).agg(*picks).select(*groups, *outs)


def five_numbers(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers within 1.5 inter-quartile ranges, outlier count.

    Whiskers and outliers come from the value counts, which are far fewer than the rows.
    """
    ranged = _ranged(_value_counts(df, groups, value), groups)
    quartiles = _quantiles(ranged, groups, {"q1": 0.25, "q2": 0.5, "q3": 0.75})
    keyed = small(quartiles.withColumnsRenamed({g: f"_g_{g}" for g in groups}))
    same = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    reach = (F.col("q3") - F.col("q1")) * 1.5
    v = F.col("_v")
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        ranged.join(keyed, same)
        .groupBy(*groups)
        .agg(
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.first("q1").alias("q1"),
            F.first("q2").alias("median"),
            F.first("q3").alias("q3"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("outliers"),
        )
    )


def summary(df: DataFrame, value: str) -> DataFrame:
    """Mean, exact median, minimum and maximum of a column, in one row."""
    middle = quantiles(df, [], value, {"median": 0.5}).select("median")
    v = F.when(~is_missing(value), F.col(value))
    return df.agg(
        F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    ).withColumn("median", middle.scalar())
