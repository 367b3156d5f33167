"""Ingest of newly landed pages until none is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_per_key
from ..sources.documents import judged
from ..sources.paged import _TIMES


def drain(spark: SparkSession, source: str, schema, target: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Move every page not seen before from ``source`` to parquet in ``target``.

    The checkpoint remembers the pages read: a second call takes only pages that
    landed since. Returns all that ``target`` holds.
    """
    reader = spark.readStream.schema(schema).options(**_TIMES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.json(source)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)


def ingest(
    spark: SparkSession,
    source: str,
    schema: str,
    target: str,
    checkpoint: str,
    keys: Sequence[str] = (),
    files_per_batch: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Move landed JSON lines not seen before to tables below ``target``; malformed ones are set aside.

    Each batch overwrites folders of its own number, ``rows/batch=<n>`` and
    ``rejects/batch=<n>``. The checkpoint gives a batch that was written but not
    committed the same number and files again, so a repeated run replaces what the
    killed one left and no row is there twice. With ``keys``, rows whose key an earlier
    batch stored are dropped, as pages that land again under another name bring them,
    and of a batch's rows with one key the one with the smallest text stays. Keys that
    are NULL are kept apart from all others.

    ``schema`` may gain columns from one run to the next: the columns of all batches are
    merged, and rows from before lack the new ones. Returns all rows, and the rejects
    (``file``, ``value``), over all batches.
    """

    def move(batch: DataFrame, number: int) -> None:
        lines = batch.where(F.trim("value") != "").withColumn("_text", F.col("value"))
        good, bad = judged(lines, schema, ["_text"], **_TIMES)
        if keys:
            named = F.lit(True)
            for k in keys:
                named = named & F.col(k).isNotNull()
            one = first_per_key(good.where(named), keys, F.col("_text"))
            before = _batches(spark, f"{target}/rows")
            if before is not None:
                one = one.join(before.where(F.col("batch") < number).select(*keys).distinct(), list(keys), "left_anti")
            good = one.unionByName(good.where(~named))
        good.drop("_text").write.mode("overwrite").parquet(f"{target}/rows/batch={number}")
        bad.select("file", "value").write.mode("overwrite").parquet(f"{target}/rejects/batch={number}")

    lines = spark.readStream.format("text")
    if files_per_batch:
        lines = lines.option("maxFilesPerTrigger", files_per_batch)
    query = (
        lines.load(source)
        .select(F.col("_metadata.file_path").alias("file"), "value")
        .writeStream.foreachBatch(move)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows, rejects = (_batches(spark, f"{target}/{name}") for name in ("rows", "rejects"))
    rows = spark.createDataFrame([], schema) if rows is None else rows.drop("batch")
    rejects = spark.createDataFrame([], "file string, value string") if rejects is None else rejects.drop("batch")
    return rows, rejects


def _batches(spark: SparkSession, folder: str) -> DataFrame | None:
    """All batches below a folder with the columns of any of them, or nothing."""
    try:
        return spark.read.option("mergeSchema", "true").parquet(folder)
    except AnalysisException as failure:
        if failure.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
