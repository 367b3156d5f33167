"""Run a small function once per entity, keeping errors apart."""

from __future__ import annotations

import signal
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType


def fan_out(df: DataFrame, entity: str, payload: str, work: Callable[[str], str | None]) -> DataFrame:
    """``(entity, result, error)`` per row; a failing entity leaves the others untouched."""
    kind = df.schema[entity].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results, errors = [], []
            for item in batch[payload]:
                try:
                    results.append(work(item))
                    errors.append(None)
                except Exception as failure:  # noqa: BLE001 - any failure is data here
                    results.append(None)
                    errors.append(f"{type(failure).__name__}: {failure}")
            yield pd.DataFrame({entity: batch[entity], "result": results, "error": errors}).astype(
                {"result": object, "error": object}
            )

    return df.select(entity, payload).mapInPandas(run, f"{entity} {kind}, result string, error string")


@contextmanager
def _deadline(seconds: float | None):
    """Raise ``TimeoutError`` in the block after some seconds; the worker's main thread runs it, so an alarm can."""
    if seconds is None:
        yield
        return

    def late(*_):
        raise TimeoutError(f"no result within {seconds:g} s")

    old = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def fan_out_rows(
    df: DataFrame, entity: str, payload: str, work: Callable[[object], Iterable[Sequence]], schema: str, deadline: float | None = None, held: int = 10_000
) -> DataFrame:
    """Any number of rows per entity: ``entity``, the columns of ``schema``, and ``error``.

    ``work`` gives the rows of one payload. An entity whose work fails, or is not done
    within ``deadline`` seconds, gives one row with the error and NULL elsewhere, and
    none of the rows that it gave before; the others are untouched. One without rows
    gives none. A task holds the rows of one entity, and emits some ``held`` at a time.
    Work that never returns to Python, as in a native library, cannot be stopped.
    """
    fields = [df.schema[entity], *StructType.fromDDL(schema).fields, StructField("error", StringType())]
    out = StructType([StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(out)
    empty = (None,) * (len(fields) - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for key, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with _deadline(deadline):
                        found = [(key, *row, None) for row in work(item)]
                        # Rows that do not fit the schema are a failure of this entity alone.
                        for c, f in zip(zip(*found), arrow):
                            pa.array(c, f.type)
                except Exception as failure:  # noqa: BLE001 - any failure is data here
                    found = [(key, *empty, f"{type(failure).__name__}: {failure}")]
                rows += found
                if len(rows) >= held:
                    yield flush()
        if rows:
            yield flush()

    return df.select(entity, payload).mapInArrow(run, out)
