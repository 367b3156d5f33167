"""Distinct counts and quantiles from small summaries that are kept per page and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import anti

# Sizes of the summaries: relative error of counts some 1.04 / sqrt(2 ** LG_K), of ranks some 2.3 / K ** 0.9.
LG_K = 12
K = 200
COUNT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LG_K / 2), 3 * 2.3 / K**0.9


def summarise(df: DataFrame, groups: Sequence[str], counted: str, measured: str) -> DataFrame:
    """For each group a summary of the distinct values of one column and of the order of another.

    Returns the groups, ``n``, ``distinct_sketch`` and ``rank_sketch``, some kilobytes a
    group whatever its rows. Tasks summarise their share before the shuffle, so a hot
    group is one row per task. Missing values are in neither summary, a group without
    values has NULL.
    """
    value = F.col(measured).cast("double")
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(counted, LG_K).alias("distinct_sketch"),
        F.kll_sketch_agg_double(F.when(~F.isnan(value), value), K).alias("rank_sketch"),
    )


def add_pages(spark: SparkSession, store: str, df: DataFrame, page: str, groups: Sequence[str], counted: str, measured: str) -> DataFrame:
    """Summarise the pages of ``df`` that ``store`` does not hold yet, and return all summaries.

    Pages summarised before are not read again: their rows are left out by their page
    before anything is aggregated.
    """
    try:
        fresh = anti(df, spark.read.parquet(store).select(page), [page])
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        fresh = df
    summarise(fresh, [page, *groups], counted, measured).write.mode("append").parquet(store)
    return spark.read.parquet(store)


def estimates(summaries: DataFrame, groups: Sequence[str], quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """Rows, distinct values and quantiles per group, from the summaries of all its pages, in any order.

    Counts are off by at most ``COUNT_ERROR`` of the count, and quantiles in rank by at
    most ``RANK_ERROR`` of the rows (three standard errors each).
    """
    merged = summaries.groupBy(*groups).agg(
        F.sum("n").alias("n"), F.hll_union_agg("distinct_sketch").alias("_d"), F.kll_merge_agg_double("rank_sketch").alias("_r")
    )
    some = F.kll_sketch_get_n_double("_r") > 0
    found = [F.when(some, F.kll_sketch_get_quantile_double("_r", F.lit(float(q)))).alias(f"q{q:g}") for q in quantiles]
    return merged.select(*groups, "n", F.hll_sketch_estimate("_d").alias("n_distinct"), *found)
