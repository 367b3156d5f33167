"""Batch ingest in pages of bounded size, and ingest of new keys only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import anti
from ..operators.ranking import number_rows
from ..operators.reshape import stack
from ..session import stored
from .documents import empty_files

# Fixed value: rows per page of the paged export.
PAGE_ROWS = 50_000

_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def land_pages(df: DataFrame, path: str, page_rows: int = PAGE_ROWS) -> str:
    """Write JSON pages that hold at most ``page_rows`` rows each."""
    df.write.option("maxRecordsPerFile", page_rows).options(**_TIMES).json(path)
    return path


def read_pages(spark: SparkSession, paths: str | Sequence[str], schema) -> DataFrame:
    """Stack all landed pages; fields a page lacks become NULL."""
    return spark.read.schema(schema).options(**_TIMES).json(paths if isinstance(paths, str) else list(paths))


def land_pages_by_offset(df: DataFrame, path: str, *order: Column, page_rows: int = PAGE_ROWS) -> str:
    """Write JSON pages of exactly ``page_rows`` rows in a total order, the last one shorter, below ``offset=<rows before>``.

    Rows are numbered in range partitions; a page is written by one task.
    """
    offset = F.floor((F.col("_row") - 1) / page_rows) * page_rows
    paged = number_rows(df, *order, name="_row").withColumn("offset", offset.cast("long"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paged.repartition(n, "offset").sortWithinPartitions("offset", "_row").drop("_row").write.partitionBy("offset").options(**_TIMES).json(path)
    return path


def read_until_short(spark: SparkSession, path: str, schema, page_rows: int = PAGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The rows of landed pages as a loop over offsets would get them, and what each page held.

    Pages lie below ``offset=<n>`` with n a multiple of ``page_rows``. All are read in
    parallel. The first page with fewer rows, an empty one included, is the last: pages
    beyond it, left over from an earlier and longer export, are not read. Returns the
    rows with their ``offset``, and a report with a row per page: ``offset``,
    ``n_rows`` and ``status``: full, last, missing (no such page before the last),
    too long, off the grid (an offset the loop would not ask for, which is not read) or
    beyond the end. Without a short page there is no last one, and all are read: the
    export may go on. Blank lines are no rows.

    The report is counted first, from lines, and has one row per page; only the last
    offset reaches the plan of the rows, as a scalar.
    """
    place = F.regexp_extract("file", r"/offset=(\d+)/", 1).cast("long")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")
    lines = lines.select(place.alias("offset"), "value").where("offset is not null")
    none = empty_files(spark, path).select(place.alias("offset"), F.lit(0).cast("long").alias("n")).where("offset is not null")
    pages = lines.groupBy("offset").agg(F.count("*").alias("n")).union(none).groupBy("offset").agg(F.sum("n").alias("n_rows"))
    on_grid = F.col("offset") % page_rows == 0
    pages = stored(pages, "pages")
    last = pages.where(on_grid & (F.col("n_rows") < page_rows)).agg(F.min("offset")).scalar()
    end = F.coalesce(last, pages.where(on_grid).agg(F.max("offset")).scalar())
    asked = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), end, F.lit(page_rows).cast("long"))).alias("offset"))
    status = (
        F.when(F.col("n_rows").isNull(), "missing").when(~on_grid, "off the grid").when(F.col("offset") > end, "beyond the end")
        .when(F.col("n_rows") < page_rows, "last").when(F.col("n_rows") > page_rows, "too long").otherwise("full")
    )
    report = asked.join(pages, "offset", "full").select("offset", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))
    row = F.from_json("value", schema, _TIMES)
    rows = lines.where(on_grid & (F.col("offset") <= end)).select("offset", row.alias("_row")).select("offset", "_row.*")
    return rows, stored(report, "page-report")


def stack_batches(*batches: DataFrame) -> DataFrame:
    """Stack batches whose columns may differ."""
    return stack(*batches)


def only_new(df: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not yet in the manifest of stored keys."""
    return anti(df, manifest.select(*keys).distinct(), keys)
