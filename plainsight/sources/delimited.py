"""Delimited text with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OPTIONS = {"header": True, "escape": '"', "multiLine": False, "nullValue": "NA"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, multi_line: bool = False) -> DataFrame:
    """Typed scan of CSV files with a header. ``multi_line`` allows line ends inside quotes."""
    return spark.read.options(**{**_OPTIONS, "multiLine": multi_line}).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).options(header=True, escape='"', nullValue="NA").csv(path)
    return path


def as_strings(columns: list[str]) -> T.StructType:
    """A schema that reads every column as text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
