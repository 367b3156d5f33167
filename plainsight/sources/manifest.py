"""Fetch each key once over many runs: a bucketed table on disk remembers the keys stored."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import first_per_key


class Manifest:
    """The keys stored so far, in ``buckets`` buckets of sorted parquet files below a shared folder.

    The folder outlives the session: the table is declared over its files again when it
    is opened with the same keys and buckets. New rows are brought to the buckets and
    merged with them, so the manifest itself, which grows with every run, is never
    shuffled or sorted again.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: dict[str, str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder, keys, buckets
        self.table = f"manifest_{hashlib.md5(folder.encode()).hexdigest()}"
        columns = ", ".join(f"`{k}` {kind}" for k, kind in keys.items())
        names = ", ".join(f"`{k}`" for k in keys)
        place = folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet"
            f" CLUSTERED BY ({names}) SORTED BY ({names}) INTO {buckets} BUCKETS LOCATION '{place}'"
        )

    def new_rows(self, df: DataFrame, *order) -> DataFrame:
        """One row, the first in ``order`` (else by hash), of each key that is not stored yet. Rows without a key are left out."""
        known = df.dropna(subset=list(self.keys)).select(*[F.col(c).cast(self.keys[c]).alias(c) if c in self.keys else c for c in df.columns])
        placed = known.repartition(self.buckets, *self.keys)
        stored = self.spark.table(self.table).hint("merge")
        first = first_per_key(placed, list(self.keys), *(order or [F.xxhash64(*placed.columns)]))
        return first.join(stored, list(self.keys), "left_anti")

    def add(self, stored_rows: DataFrame) -> None:
        """Remember the keys of rows that are stored. Called after storing: a run killed before fetches again, and loses nothing."""
        keys = stored_rows.select(*[F.col(k).cast(kind).alias(k) for k, kind in self.keys.items()]).distinct()
        placed = keys.repartition(self.buckets, *self.keys)
        placed.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).mode("append").saveAsTable(self.table)


def fetch_once(manifest: Manifest, df: DataFrame, target: str, *order) -> DataFrame:
    """Store the rows of ``df`` with keys not stored before in the folder ``target``, and return them."""
    fresh = manifest.new_rows(df, *order)
    fresh.write.parquet(target)
    kept = manifest.spark.read.schema(fresh.schema).parquet(target)
    manifest.add(kept)
    return kept
