"""Pack documents into sequences of equal length by multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .rows import fields, give_back, quoted, slices
from .tokens import default_path, encoder

_PIECE = "start long, length long, ids binary, doc_tokens long, part int, at long, rest_end long"
# Sequence ids set aside for a block.
_BLOCK_IDS = 1 << 20


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: a window for each item, and the sums of the ``k`` windows.

    Each item starts as a partition of its own, with the item in one window and the
    others empty. The two partitions with the widest spread are merged, fullest
    windows of one with emptiest of the other, until one is left. Only the order of
    the windows is kept per merge; walking back from the last one gives the items'.
    """
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()] if k == 1 else [0] * k)
    sums: dict[int, np.ndarray] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray]] = []

    def opened(node: int) -> np.ndarray:
        if node >= n:
            return sums.pop(node)
        leaf = np.zeros(k, np.int64)
        leaf[0] = sizes[node]
        return leaf

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = opened(a) + opened(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(merges)
        merges.append((a, b, order))
        sums[node] = both
        heapq.heappush(heap, (int(both[-1] - both[0]), node))
    root = heap[0][1]
    final = opened(root)
    window = np.zeros(n, np.int64)
    places = {root: np.arange(k)}
    for node in range(n + len(merges) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        at = np.empty(k, np.int64)
        at[order] = places.pop(node)
        for child, slots in ((a, at), (b, at[::-1])):
            if child < n:
                window[child] = slots[0]
            else:
                places[child] = slots
    return window, final


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """A window for each item so that none exceeds ``capacity``, and how many there are.

    Starts with as few windows as the total needs and takes one more whenever
    differencing leaves one over capacity. No item may be larger than that.
    """
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, sums = differencing(sizes, k)
        if sums.max(initial=0) <= capacity:
            return window, k
        k += 1


def bundles(lengths: np.ndarray, grain: int) -> np.ndarray:
    """Numbers neighbouring pieces alike while they stay within ``grain`` ids together."""
    out, item, room = np.empty(len(lengths), np.int64), -1, -1
    for i, n in enumerate(lengths.tolist()):
        if n > room:
            item, room = item + 1, max(grain, n)
        out[i], room = item, room - n
    return out


def cut(
    docs: DataFrame, capacity: int = 2048, grain: int = 256, end_id: int = 1, path: str | None = None, text_col: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Tokenize whole texts and cut them into pieces.

    A document is its ids and ``end_id``. As many pieces of ``capacity`` as fit come
    first; the rest is cut into pieces of at most ``grain``. Returns one row per piece:
    the id, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    and where it stands: ``part``, the task, ``at``, the ids before it in that task, and
    ``rest_end``, the ids of shorter pieces up to its end.
    A missing text is empty and has the end id alone; rows with one id are documents
    of their own.
    """
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    id_field = docs.schema[id_col]
    schema = StructType([id_field, *fields(_PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path).encode, TaskContext.get().partitionId(), 0
        rest = 0
        for whole in batches:
            for batch in slices(whole, 4 << 20):
                owner, starts, lengths, ids, totals, ats, ends = [], [], [], [], [], [], []
                for row, data in enumerate(encode(batch.column(1))):
                    data += end
                    total = len(data) // 4
                    full = total // capacity * capacity
                    edges = [*range(0, full, capacity), *range(full, total, grain), total]
                    for a, b in zip(edges, edges[1:]):
                        owner.append(row)
                        starts.append(a)
                        lengths.append(b - a)
                        ids.append(data[4 * a : 4 * b])
                        totals.append(total)
                        ats.append(at + a)
                        rest += (b - a) * (b - a < capacity)
                        ends.append(rest)
                    at += total
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(ats, pa.int64()), pa.array(ends, pa.int64())],
                    names=schema.fieldNames(),
                )
            give_back()
        encoder(path).rest()
        give_back()

    return docs.select(F.col(quoted(id_col)), F.col(quoted(text_col))).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, grain: int = 256, block_windows: int = 128) -> DataFrame:
    """Assign pieces to sequences: adds ``sequence_id`` and ``offset``.

    ``pieces`` are rows of :func:`cut`, with any other columns in place of ``ids``.
    Pieces of full length are sequences of their own. The others, in input order, form
    blocks of ``block_windows * capacity`` ids; each block is one group, whose size does
    not depend on the data, and is partitioned by :func:`windows`. Only the last block
    of the whole table can be much smaller. Sequence ids are unique, not dense.
    """
    pieces = stored(pieces, "pieces")
    carried = [c for c in pieces.columns if c not in ("part", "at", "rest_end")]
    # One row per task that cut documents.
    totals = pieces.groupBy("part").agg(F.max(F.col("at") + F.col("length")).alias("_all"), F.max("rest_end").alias("_short"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_all", "_short")])
    placed = pieces.join(F.broadcast(totals), "part")
    whole = placed.where(F.col("length") == capacity).select(
        *carried, ((F.col("_all") + F.col("at")) * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    position = F.col("_short") + F.col("rest_end") - F.col("length")
    short = placed.where(F.col("length") < capacity).select(
        *carried, position.alias("_position"), F.floor(position / (block_windows * capacity)).alias("_block")
    )
    schema = StructType([*[pieces.schema[c] for c in carried], *fields("sequence_id long, offset long").fields])

    def block(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_position", kind="stable").reset_index(drop=True)
        item = bundles(pdf["length"].to_numpy(), grain)
        window, _ = windows(np.bincount(item, weights=pdf["length"]).astype(np.int64), capacity)
        pdf["sequence_id"] = (key[0] * _BLOCK_IDS + window[item]) * 2
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf[schema.fieldNames()]

    return whole.unionByName(short.groupBy("_block").applyInPandas(block, schema))
