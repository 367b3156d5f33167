"""From raw documents to packed sequences: stages that each read what the last one wrote.

Each stage is a function of ``(spark, docs, sf_dir)``. All but the last return the
columns of ``documents``; ``n_chars`` follows the text where lines are dropped. A row
stays unless a stage rejects it: documents with an empty text are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plainsight.llm import decontaminate, lines, minhash, packing, toxicity
from plainsight.llm.queries import tuned
from plainsight.session import stored
from plainsight.tables import Tables


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier trained on ``labels`` does not call toxic."""
    return toxicity.drop_toxic(docs, Tables(tuned(spark), sf_dir).labels)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten of them or more share."""
    tuned(spark)
    kept = lines.drop_common_lines(docs)
    if "n_chars" in docs.columns:
        n = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, n).otherwise(F.col("n_chars")))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share four fifths of their five-word shingles, the one with the smallest id."""
    tuned(spark)
    return minhash.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ``benchmark`` passage is found."""
    return decontaminate.drop_contaminated(docs, Tables(tuned(spark), sf_dir).benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, and their places in sequences of 2048."""
    tuned(spark)
    return packing.pack(packing.cut(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL cannot train the first stage's classifier; the tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again."""
    docs = Tables(tuned(spark), sf_dir).documents
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
