"""Nested JSON documents, with unreadable ones set aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRUPT = "_corrupt_record"

PLAYLIST = (
    "name string, pid bigint, num_followers bigint, tracks array<struct<"
    "pos: int, artist_name: string, artist_uri: string, track_name: string, track_uri: string, "
    "album_name: string, album_uri: string, duration_ms: bigint>>"
)
PLAYLIST_DOCUMENT = f"playlists array<struct<{PLAYLIST}>>"


def _one_object(value: str) -> Column:
    """Whether nothing but white space follows the first object of a text.

    The parser stops at the end of an object. Put into another one, the text must leave
    it open, so that the field after it is read; that holds the text's own hash.
    """
    own = F.xxhash64(value)
    around = F.concat(F.lit('{"value": '), value, F.lit(', "end": '), own.cast("string"), F.lit("}"))
    return F.from_json(around, "end bigint")["end"] == own


def judged(texts: DataFrame, schema: str, keep: Sequence[str] = (), **options: str) -> tuple[DataFrame, DataFrame]:
    """Parsed records, after the columns in ``keep``, and rows whose ``value`` is no JSON object of the schema: one verdict for each."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, **options}
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", options)
    texts = texts.withColumn("_doc", parsed)
    # Records that parse to nothing, such as null, arrays and numbers, have no object to start with.
    good = F.ltrim("value").startswith("{") & F.col("_doc").isNotNull() & F.col(f"_doc.{CORRUPT}").isNull() & _one_object("value")
    ok = F.coalesce(good, F.lit(False))
    return texts.where(ok).select(*keep, "_doc.*").drop(CORRUPT), texts.where(~ok).drop("_doc")


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """The files of no bytes, which Spark lists but does not open: (``file``)."""

    def plain(c):
        return F.regexp_replace(c, "^file:/+", "file:///")

    text = spark.read.text(path)
    listed = spark.createDataFrame([(f,) for f in text.inputFiles()], "file string")  # the driver holds this list anyway
    opened = filled_files(spark, path).select(plain("file").alias("file"))
    return listed.select(plain("file").alias("file")).join(opened, "file", "left_anti")


def filled_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that have bytes, a row each: (``file``, ``name``, ``length``), ``file`` being the escaped name. Their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("path").alias("name"), "length")


def read_documents(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Documents, one per JSON file over any number of lines, and unreadable files (``file``, ``value``).

    A file is one value of one task; for large ones see :mod:`split_documents`. Files of
    no bytes have an empty value.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    good, bad = judged(files, schema)
    return good, bad.unionByName(empty_files(spark, path).select("file", F.lit("").alias("value")))


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records and quarantined lines (``file``, ``value``) of newline-delimited JSON files.

    Blank lines are on neither side.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    return judged(lines.where(F.trim("value") != ""), schema)


def parse_documents(df: DataFrame, col: str, schema: str) -> DataFrame:
    """Replace a column of JSON text by the fields of its documents."""
    kept = [c for c in df.columns if c != col]
    return df.withColumn("_doc", F.from_json(col, schema)).select(*kept, "_doc.*")
