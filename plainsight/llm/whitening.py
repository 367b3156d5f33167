"""Whiten vectors by their leading principal components, found by FEAST contour integration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import stored
from .rows import fields, give_back, others, quoted, slices

# Entries are fixed-point numbers: floor(64 * c) + 1000000.
_SCALE, _SHIFT = 64, 1_000_000
# Beyond this a fixed-point entry has no exact double.
_LARGEST = float(1 << 46)


# ---- the spectrum of one symmetric matrix ----


class Inertia:
    """Counts the eigenvalues of a symmetric matrix on either side of any shift.

    The matrix is brought to tridiagonal form by Householder reflections once. For a
    shift, the signs of the pivots of ``T - shift`` (factored without its square
    roots) are those of the eigenvalues, by Sylvester's law of inertia.
    """

    def __init__(self, matrix: np.ndarray):
        a = matrix.copy()
        n = len(a)
        for k in range(n - 2):
            x = a[k + 1 :, k].copy()
            norm = np.linalg.norm(x)
            if norm == 0:
                continue
            x[0] += np.copysign(norm, x[0])
            x /= np.linalg.norm(x)
            rest = a[k + 1 :, k:]
            rest -= 2 * np.outer(x, x @ rest)
            rest = a[k:, k + 1 :]
            rest -= 2 * np.outer(rest @ x, x)
        self.diagonal, self.squares = np.diag(a).copy(), np.diag(a, -1) ** 2 if n > 1 else np.zeros(0)
        self.scale = float(np.abs(self.diagonal).max(initial=0) + 2 * np.sqrt(self.squares.max(initial=0)))

    def above(self, shift: float) -> int:
        """How many eigenvalues exceed the shift."""
        tiny = 1e-150 * max(self.scale, 1e-150)
        count, pivot = 0, 1.0
        for i, d in enumerate(self.diagonal):
            pivot = d - shift - (self.squares[i - 1] / pivot if i else 0.0)
            if abs(pivot) < tiny:
                pivot = -tiny
            count += pivot > 0
        return count

    def value(self, rank: int) -> float:
        """The eigenvalue that ``rank`` others exceed or equal, by bisection."""
        low, high = -self.scale * 1.01 - 1e-300, self.scale * 1.01 + 1e-300
        while high - low > 2 * np.finfo(float).eps * self.scale:
            middle = (low + high) / 2
            if self.above(middle) > rank:
                low = middle
            else:
                high = middle
        return (low + high) / 2

    def cut(self, wanted: int, apart: float = 1e-12) -> tuple[float, int]:
        """The middle of a gap below ``wanted`` eigenvalues, or a few more where the next are too close; and how many."""
        upper = self.value(wanted - 1)
        for n in range(wanted, len(self.diagonal)):
            lower = self.value(n)
            if upper - lower > apart * self.scale:
                return (upper + lower) / 2, n
            upper = lower
        return -self.scale * 1.01, len(self.diagonal)


def feast(
    matrix: np.ndarray, low: float, high: float, count: int, nodes: int = 8, rounds: int = 40, seed: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of a symmetric matrix between two shifts, by contour integration.

    The integral of the resolvent around the interval projects on its eigenvectors. It is
    summed by Gauss-Legendre quadrature over the upper half circle, one complex shifted
    solve per node; the lower half is its conjugate. Rayleigh-Ritz on the projected
    subspace gives the pairs, and the subspace is projected again until residuals end
    to fall. ``count`` comes from inertia: another number of pairs in the interval
    raises an error, as one would be missed.
    """
    n = len(matrix)
    size = min(n, max(count + 4, int(1.5 * count) + 1))
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - at)
    shifts = centre + radius * np.exp(1j * angle)
    basis = np.random.default_rng(seed).normal(size=(n, size))
    scale = max(np.abs(matrix).max(initial=0), 1e-300)
    best, kept = np.inf, None
    for _ in range(rounds):
        projected = np.zeros((n, size))
        for shift, turn, w in zip(shifts, angle, weight):
            solved = np.linalg.solve(shift * np.eye(n) - matrix, basis)
            projected += (w / 2 * radius * np.exp(1j * turn) * solved).real
        q, _ = np.linalg.qr(projected)
        small = q.T @ matrix @ q
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        basis = q @ vectors
        inside = (values > low) & (values <= high)
        if inside.sum() != count:
            continue
        pairs = values[inside], basis[:, inside]
        residual = np.abs(matrix @ pairs[1] - pairs[1] * pairs[0]).max(initial=0) / scale
        if kept is not None and residual >= best / 2:
            break
        best, kept = min(best, residual), pairs
    if kept is None or best > 1e-11:
        raise ArithmeticError(f"eigenvalues between {low} and {high}: {count} by inertia, not found by the contour")
    return kept


def _between(matrix: np.ndarray, inertia: Inertia, high: float, above: int, low: float, count: int) -> list[np.ndarray]:
    """Eigenvectors of the ``count`` eigenvalues between the shifts; ``above`` more lie higher.

    The contour is drawn close around them. Where it does not settle, since neighbours
    outside are too near for its width, each half gets one of its own.
    """
    top, bottom = inertia.value(above), inertia.value(above + count - 1)
    margin = (top - bottom) / 4 + inertia.scale * 1e-3
    try:
        return [feast(matrix, max(low, bottom - margin), min(high, top + margin), count)[1]]
    except (ArithmeticError, np.linalg.LinAlgError):
        if count > 1:
            border, n = inertia.cut(above + count // 2)
            if above < n < above + count:
                return [*_between(matrix, inertia, high, above, border, n - above), *_between(matrix, inertia, border, n, low, above + count - n)]
        # One eigenvalue, or several that rounding cannot part: as far from the borders as they allow.
        reach = 0.9 * min(high - top, bottom - low)
        return [feast(matrix, bottom - reach, top + reach, count)[1]]


def leading_pairs(matrix: np.ndarray, wanted: int, per_interval: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite matrix, falling, with unit eigenvectors.

    Inertia counts cut the spectrum into intervals of some ``per_interval`` eigenvalues
    with borders in its gaps; each goes through :func:`feast`, and one last
    Rayleigh-Ritz step over all found makes them orthogonal across borders. Eigenvalues
    that rounding cannot tell from zero are left out.
    """
    n = len(matrix)
    top = float(np.trace(matrix)) if n else 0.0
    if not top > 0:
        return np.zeros(0), np.zeros((n, 0))
    # Work on a scale of one, whatever the entries are.
    matrix = matrix / top
    inertia = Inertia(matrix)
    floor = n * np.finfo(float).eps * max(inertia.scale, 1.0)
    wanted = min(wanted, inertia.above(floor))
    high, found, vectors = inertia.scale * 1.01, 0, []
    while found < wanted:
        low, above = inertia.cut(min(found + per_interval, wanted))
        vectors += _between(matrix, inertia, high, found, low, above - found)
        high, found = low, above
    q, _ = np.linalg.qr(np.concatenate(vectors, axis=1))
    small = q.T @ matrix @ q
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:wanted]
    return values[order] * top, q @ turn[:, order]


# ---- sums over Spark's partitions ----


@dataclass(frozen=True)
class Moments:
    """Rows, their mean and covariance (divisor: the rows); two of them add up without cancellation."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> "Moments":
        mean = rows.mean(axis=0)
        centred = rows - mean
        return cls(len(rows), mean, centred.T @ centred)

    def __add__(self, other: "Moments") -> "Moments":
        n = self.n + other.n
        step = other.mean - self.mean
        scatter = self.scatter + other.scatter + np.outer(step, step) * (self.n / n * other.n)
        return Moments(n, self.mean + step * (other.n / n), scatter)

    def packed(self) -> bytes:
        return np.concatenate([[float(self.n)], self.mean, self.scatter.ravel()]).tobytes()

    @classmethod
    def unpacked(cls, data: bytes, dim: int) -> "Moments":
        x = np.frombuffer(data)
        return cls(int(x[0]), x[1 : dim + 1], x[dim + 1 :].reshape(dim, dim))


def _moments(df: DataFrame, dim: int, rows_of, fan_in: int = 64) -> Moments | None:
    """Moments of what ``rows_of`` makes of each batch: one row of sums per task, added up in a tree of tasks."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in slices(batch):
                found = Moments.of(rows_of(part))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], names=["sums"])
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(0):
                found = Moments.unpacked(data.as_py(), dim)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], names=["sums"])

    sums = stored(df.mapInArrow(partial, "sums binary"), "moments")
    while sums.count() > fan_in:
        parts = -(-sums.count() // fan_in)
        sums = stored(sums.repartition(parts).mapInArrow(merge, "sums binary"), "moments")
    total = None
    for (data,) in sums.collect():  # at most fan_in matrices
        found = Moments.unpacked(bytes(data), dim)
        total = found if total is None else total + found
    return total


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


@dataclass(frozen=True)
class Whitening:
    """What the fit keeps: exact sums of the distinct vectors, eigenvalues, the map, and how well it whitens."""

    dim: int
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, from exact integers."""
        return self.exact(x).astype(float) / self.n

    def exact(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S`` without rounding; Python's integers where 64 bits are too few."""
        largest = max(int(np.abs(x).max(initial=0)), 1)
        if largest * self.n < 1 << 62 and np.abs(self.sums).max(initial=0) < 1 << 62:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of :meth:`exact` for each row; null beyond 64 bits."""
        d = self.exact(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * self.dim < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in (d.astype(object) ** 2).sum(axis=1)]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def fixed_point(vectors: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """Rows with a usable vector, with it as whole numbers in ``_x``; and the vectors' length, that of most rows."""
    vector = F.col(quoted(vector_col))
    usable = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    size = F.size(vector)
    rows = vectors.where(vector.isNotNull() & (size > 0)).where(F.coalesce(usable, F.lit(False)))
    small = F.forall(vector, lambda c: F.abs(c.cast("double") * _SCALE) < _LARGEST)
    rows = rows.where(small)
    length = rows.groupBy(size.alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = length["dim"] if length else 0
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * _SCALE) + F.lit(_SHIFT).cast("long"))
    return rows.where(size == dim).withColumn("_x", whole), dim


def fit(rows: DataFrame, dim: int, components: int = 16) -> Whitening | None:
    """Fit on the distinct vectors of ``_x``, as :func:`fixed_point` makes them; nothing without rows or spread.

    Equal vectors are found by grouping on the whole vector, partly before the shuffle.
    Sums are exact. Each task adds up the products of its centred rows; matrices of
    ``dim ** 2`` numbers are merged by tasks, at most 64 reach the driver, which holds
    one matrix of that size for the eigenvalues. ``dim`` does not grow with the table.
    """
    distinct = stored(rows.select("_x").distinct(), "distinct-vectors")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_ = np.zeros(dim, object), 0
        for batch in batches:
            for part in slices(batch):  # entries are below 2 ** 47, so a slice's sums are whole numbers of 64 bits
                total, rows_ = total + _matrix(part.column(0), dim).sum(axis=0), rows_ + part.num_rows
        if rows_:
            sums = pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), sums, pa.array(np.full(dim, rows_))], names=["at", "s", "n"])

    sums = distinct.mapInArrow(add_up, "at long, s decimal(38,0), n long").groupBy("at").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = sums.orderBy("at").collect()  # one row per dimension
    if not found:
        return None
    n, sums_ = found[0]["n"], np.array([int(r["s"]) for r in found], object)
    start = Whitening(dim, n, sums_, np.zeros(0), np.zeros((dim, 0)), 0.0, 0.0)
    total = _moments(distinct, dim, lambda batch: start.centred(_matrix(batch.column(0), dim)))
    covariance = total.scatter / n
    values, turn = leading_pairs((covariance + covariance.T) / 2, components)
    if not len(values):
        return None
    model = Whitening(dim, n, sums_, values, turn, float(np.trace(covariance)), 0.0)
    check = _moments(distinct, len(values), lambda batch: model.whitened(_matrix(batch.column(0), dim)))
    error = float(np.abs(check.scatter / n - np.eye(len(values))).max())
    return Whitening(dim, n, sums_, values, turn, model.trace, error)


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every vector along the leading principal components, scaled to variance one.

    Returns for each row of ``vectors`` with a usable vector and each component, from 1
    by falling eigenvalue: the other columns of ``vectors``, ``component``, ``n`` (the
    distinct vectors of the fit), ``deviation`` (exact sum of squares of ``n * x - S``,
    null beyond 64 bits), ``whitened``, ``explained`` (the eigenvalue's share of the
    trace) and ``identity_error`` (how far the covariance of ``whitened`` over the fit
    list is from the identity, one value). Columns of these names are replaced.

    Vectors are read as whole numbers ``x = floor(64 * c) + 1000000``. Those that are
    missing or empty, or hold missing or non-finite entries or one of 2 ** 40 or more,
    are dropped, as are vectors of another length than most rows have (of equally
    frequent lengths the largest counts). Repeated rows each get their result, and count
    once in the fit. Components without spread are left out, so one distinct vector, or
    an empty table, gives no rows. Equal eigenvalues share a plane, in which the
    directions are arbitrary but the same for all rows.
    """
    added = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in others(vectors, added) if c.lower() != vector_col.lower()]
    renamed = vectors.select(*[F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(kept)], F.col(quoted(vector_col)).alias("_vector"))
    rows, dim = fixed_point(renamed, "_vector")
    rows = stored(rows.drop("_vector"), "whole-vectors")
    own = [f"_{i}" for i in range(len(kept))]
    results = fields("_component int, _n long, _deviation long, _whitened double, _explained double, _identity_error double")
    schema = StructType(rows.select(*own).schema.fields + results.fields)
    names = {f"_{i}": c for i, c in enumerate(kept)} | {f"_{c}": c for c in added}
    model = fit(rows, dim, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnsRenamed(names)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # a few rows of the matrix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.values)
        for batch in batches:
            for part in slices(batch, 1 << 20):
                size = part.num_rows
                x = _matrix(part.column(part.num_columns - 1), m.dim)
                at = pa.array(np.repeat(np.arange(size), k))
                deviation = pa.array(m.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(i).take(at) for i in range(len(own))],
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, m.n, np.int64)),
                        deviation.take(at), pa.array(m.whitened(x).ravel()),
                        pa.array(np.tile(m.values / m.trace, size)), pa.array(np.full(size * k, m.identity_error)),
                    ],
                    names=schema.fieldNames(),
                )
        give_back()

    return rows.select(*own, "_x").mapInArrow(run, schema).withColumnsRenamed(names)
