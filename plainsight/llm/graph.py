"""Connected components of a graph given by its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that are not the smallest of their component, and the smallest."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[:n].tolist(), at[n:].tolist()):
        x, y = find(x), find(y)
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def forest(edges: pa.Table) -> pa.RecordBatch:
    """Edges of the same components, at most one per node."""
    v, u = union_find(*[edges.column(i).to_numpy() for i in (0, 1)])
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], names=edges.column_names)


def _contracted(edges: DataFrame, max_edges: int) -> DataFrame:
    """Edges of the same components, as stars within each task's share of the edges.

    A task groups at most ``max_edges`` at a time, so its memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n > max_edges:
                yield forest(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield forest(pa.Table.from_batches(held))

    return edges.mapInArrow(run, "v long, u long")


def components(edges: DataFrame, max_edges: int = 500_000) -> DataFrame:
    """The smallest node of each component: rows (``node``, ``component``).

    ``edges`` are two columns of numbers, in either direction, repeated or not. Only
    nodes with an edge to another are returned. Each task first joins what its own
    edges connect; then large-star and small-star steps alternate until the edges stay
    the same. Each step is written to the shared folder and read back, so a lost
    executor costs one step. A node with very many edges is no obstacle: minima are
    aggregated before the shuffle and the join back is one that AQE splits.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u")
    pairs = stored(_contracted(pairs, max_edges), "edges")
    if pairs.count() <= max_edges:
        return stored(_contracted(pairs.coalesce(1), max_edges).toDF("node", "component"), "components")
    state = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        # Large star: neighbours above a node move to its smallest neighbour or itself.
        lowest = stored(both.groupBy("v").agg(F.least("v", F.min("u")).alias("m")), "lowest")
        upper = both.where("u > v")
        moved = upper.join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        # Small star: neighbours below a node, and the node, move to the smallest of them.
        moved = stored(moved, "large-star")
        lowest = stored(moved.groupBy("v").agg(F.min("u").alias("m")), "lowest")
        lower = moved.join(lowest, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        pairs = stored(lower.unionByName(lowest.select("v", F.col("m").alias("u"))).distinct(), "small-star")
        check = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if tuple(check) == state:
            return pairs.toDF("node", "component")
        state = tuple(check)
