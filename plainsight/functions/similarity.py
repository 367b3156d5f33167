"""Jaro similarity, scored a whole Arrow batch of pairs at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_CELLS_PER_BLOCK = 1 << 19


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points padded with -1, and lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.full((len(texts), max(1, int(lengths.max(initial=0)))), -1, dtype=np.int64)
    for i, t in enumerate(texts):
        codes[i, : len(t)] = [ord(ch) for ch in t]
    return codes, lengths


def _in_order(codes: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Matched code points of each row moved to the front, order kept."""
    front = np.argsort(~hit, axis=1, kind="stable")
    return np.take_along_axis(np.where(hit, codes, -1), front, axis=1)


def jaro_block(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro similarity of each pair; half transpositions are rounded down."""
    a, la = _codes(left)
    b, lb = _codes(right)
    rows = np.arange(len(left))
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    hit_a = np.zeros(a.shape, dtype=bool)
    hit_b = np.zeros(b.shape, dtype=bool)
    columns = np.arange(b.shape[1])[None, :]
    for i in range(a.shape[1]):
        free = (
            (b == a[:, i : i + 1])
            & ~hit_b
            & (np.abs(columns - i) <= reach[:, None])
            & (i < la)[:, None]
            & (columns < lb[:, None])
        )
        found = free.any(axis=1)
        hit_a[found, i] = True
        hit_b[rows[found], free[found].argmax(axis=1)] = True
    m = hit_a.sum(axis=1)
    ma, mb = _in_order(a, hit_a), _in_order(b, hit_b)
    width = min(ma.shape[1], mb.shape[1])
    moved = ((ma[:, :width] != mb[:, :width]) & (np.arange(width)[None, :] < m[:, None])).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        score = (m / la + m / lb + (m - moved) / m) / 3.0
    score[m == 0] = 0.0
    score[(la == 0) & (lb == 0)] = 1.0
    return score


def _score(left: pd.Series, right: pd.Series) -> pd.Series:
    """Jaro similarity of two text columns; NULL if either is NULL."""
    known = (left.notna() & right.notna()).to_numpy()
    out = np.full(len(left), np.nan)
    where = np.flatnonzero(known)
    # Pairs of like length share a block, so one long text widens few others.
    size = left.iloc[where].str.len().to_numpy() + right.iloc[where].str.len().to_numpy()
    order = np.argsort(size, kind="stable")
    where, size = where[order], size[order]
    start = 0
    while start < len(where):
        # At most so many rows that the longest text of the block fits the budget.
        stop = min(len(where), start + 4096)
        while stop - start > 1 and (stop - start) * size[stop - 1] > _CELLS_PER_BLOCK:
            stop = start + (stop - start) // 2
        block = where[start:stop]
        out[block] = jaro_block(left.iloc[block].tolist(), right.iloc[block].tolist())
        start = stop
    return pd.Series(out)


jaro = pandas_udf(_score, DoubleType())
# For a score that is filtered on as well as kept: Catalyst copies a
# deterministic call into the filter and would score every pair twice.
jaro_once = pandas_udf(_score, DoubleType()).asNondeterministic()
