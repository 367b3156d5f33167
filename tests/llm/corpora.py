"""Tables for the tests of this folder."""

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Make a documents table from (id, text) rows, with a column that clashes with what operators add."""

    def make(rows, clash=()):
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOC)
        for name in clash:
            df = df.withColumn(name, F.lit("theirs"))
        return df

    return make
