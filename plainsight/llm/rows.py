"""Helpers shared by the operators: folds, added columns, shared files."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id is in fold 0."""
    return F.pmod(F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)), F.lit(n))


def fold_of(value, n: int) -> int:
    """:func:`fold` of one value, in Python."""
    return 0 if value is None else zlib.crc32(str(value).encode()) % n


def others(df: DataFrame, added: Sequence[str]) -> list[str]:
    """The columns of ``df`` that no added column replaces (names compare without case)."""
    taken = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_arrays(
    df: DataFrame,
    inputs: Sequence[str],
    added: StructType,
    f: Callable[[], Callable[..., Sequence]],
    drop: Sequence[str] = (),
    max_bytes: int = 4 << 20,
) -> DataFrame:
    """Append columns that a Python function computes from Arrow arrays.

    ``f()`` is called once per task and returns a function from the arrays of
    ``inputs`` to the new columns; it gets some ``max_bytes`` at a time. Columns of
    ``df`` pass through untouched, but for those in ``drop``; one with the name of a
    new column is replaced by it.
    """
    kept = others(df, [*added.fieldNames(), *drop])
    at = [df.columns.index(c) for c in inputs]
    positions = [df.columns.index(c) for c in kept]
    schema = StructType([df.schema.fields[i] for i in positions] + list(added.fields))
    kinds = [to_arrow_type(x.dataType) for x in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = f()
        for batch in batches:
            # Nested slices keep the batch that Python works on small where texts are long.
            for part in slices(batch, max_bytes):
                new = compute(*[part.column(i) for i in at])
                arrays = [part.column(i) for i in positions] + [
                    x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(new, kinds)
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.fieldNames())
        del compute
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system, since a worker stays for later tasks, where the C library can do so."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``max_bytes``, of one row at least."""
    n = batch.num_rows
    if n == 0:
        return
    step = max(1, min(n, int(n * max_bytes / max(batch.nbytes, 1))))
    for start in range(0, n, step):
        yield batch.slice(start, step)


def fields(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def open_folder(uri: str):
    """The Arrow file system and path of a folder that all executors share."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)
