"""Compare the members of buckets in blocks, however large a bucket is."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .rows import give_back


def cells(rows: DataFrame, keys: Sequence[str], member: str, block: int = 2048) -> DataFrame:
    """Deal bucket members to cells that together hold every pair of a bucket once.

    A bucket of up to ``block`` rows is one cell. A larger one is cut by hash into k
    blocks, and each row goes to the k cells (i, j) of its block, so that no task gets
    more than two blocks of a bucket at once. Adds ``cell_i``, ``cell_j`` and ``side``,
    the row's block. Buckets with one row are left out, as they hold no pair.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_size")).where("_size > 1")
    # A table, so that AQE sees its size and can split a hot bucket's rows.
    sizes = stored(sizes, "buckets")
    k = F.ceil(F.col("_size") / block).cast("int")
    side = F.pmod(F.xxhash64(member), F.col("_k")).cast("int")
    dealt = rows.join(sizes, list(keys)).withColumn("_k", k).withColumn("side", side)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    low, high = F.least("side", "_other"), F.greatest("side", "_other")
    return dealt.withColumn("cell_i", low).withColumn("cell_j", high).drop("_size", "_k", "_other")


def compare(
    dealt: DataFrame,
    keys: Sequence[str],
    schema: StructType | str,
    f: Callable[[pa.Table, np.ndarray, np.ndarray], pa.RecordBatch],
    pairs: int = 200_000,
    combine: Callable[[pa.Table], pa.RecordBatch] | None = None,
) -> DataFrame:
    """Run ``f(rows, left, right)`` on the pairs of each cell, some ``pairs`` at a time.

    ``left`` and ``right`` are row positions in ``rows``, which holds whole cells. Each
    pair comes once. The rows that ``f`` returns are the result; ``combine`` may shorten
    those of some cells that a task holds together.
    """
    by = [*keys, "cell_i", "cell_j"]

    def finish(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = rows.num_rows
        new = np.zeros(n + 1, bool)
        new[[0, n]] = True
        for c in by:
            values = rows[c].to_numpy()
            new[1:n] |= values[1:] != values[:-1]
        edges = np.flatnonzero(new)
        cell = np.cumsum(new[:n]) - 1
        end = edges[cell + 1]
        side, i, j = (rows[c].to_numpy() for c in ("side", "cell_i", "cell_j"))
        # Partners of a row are neighbours: those after it, or the whole second block.
        second = np.bincount(cell, weights=side == j, minlength=len(edges) - 1).astype(np.int64)
        first = np.where(i == j, np.arange(n) + 1, end - second[cell])
        count = np.where((i == j) | (side == i), end - first, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        at, outs = 0, []
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, total[at] + pairs, "right")) - 1)
            own = count[at:to]
            left = np.repeat(np.arange(at, to), own)
            if len(left):
                right = np.arange(len(left)) - np.repeat(total[at:to] - total[at], own) + np.repeat(first[at:to], own)
                out = f(rows, left, right)
                if out.num_rows and combine:
                    outs.append(out)
                elif out.num_rows:
                    yield out
            at = to
        if outs:
            yield combine(pa.Table.from_batches(outs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # The last cell may go on in the next batch.
            last = np.ones(held.num_rows, bool)
            for c in by:
                values = held[c].to_numpy()
                last &= values == values[-1]
            start = held.num_rows - int(last.sum())
            if start:
                yield from finish(held.slice(0, start).combine_chunks())
                held = held.slice(start).combine_chunks()
        if held is not None:
            yield from finish(held.combine_chunks())
        held = None
        give_back()

    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *by).sortWithinPartitions(*by, "side").mapInArrow(run, schema)
