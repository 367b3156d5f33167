import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plainsight.llm import queries, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def brute(rows, components=16):
    """Results by plain numpy, from (id, whole vector) rows."""
    fit = sorted(set(map(tuple, (x for _, x in rows))))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array([s / n for s in sums])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    values, vectors = values[order], vectors[:, order]
    out = {}
    for i, x in rows:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        y = (np.array(x) - np.array([s / n for s in sums])) @ vectors / np.sqrt(values)
        for k in range(len(values)):
            out.setdefault((i, k + 1), []).append((n, deviation, y[k], values[k] / np.trace(covariance)))
    return out


def check(got, want):
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted(k for k, v in want.items() for _ in v)
    signs = {}
    for r in got:
        n, deviation, y, explained = want[r["vec_id"], r["component"]][0]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        if abs(y) > 1e-6:
            assert signs.setdefault(r["component"], np.sign(y * r["whitened"])) == np.sign(y * r["whitened"])
        assert abs(r["whitened"]) == pytest.approx(abs(y), rel=1e-6, abs=1e-8)
        assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("dim, n", [(20, 60), (3, 40), (1, 9)])
def test_whitened_rows_equal_brute_force(spark, dim, n):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(n, dim)) * np.linspace(1, 4, dim)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(100, vectors[0]), (101, vectors[0]), (0, vectors[0])]
    odd = [(200, None), (201, []), (202, [NAN] * dim), (203, [INF] + [0.0] * (dim - 1)), (204, [None] * dim), (205, [1.0] * (dim + 1)), (206, [1e30] * dim)]
    df = spark.createDataFrame([(*r, None) for r in rows + odd], SCHEMA).withColumn("N", F.lit("theirs")).repartition(5)
    got = whitening.whiten(df, id_col="vec_id").collect()
    want = brute([(i, whole(v)) for i, v in rows])
    assert "N" not in got[0].asDict() and got[0]["label"] is None
    check(got, want)


def test_vectors_without_spread_give_nothing(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], None), (2, [1.0, 2.0], None)], SCHEMA)
    assert whitening.whiten(one).count() == 0
    empty = whitening.whiten(one.limit(0))
    assert empty.count() == 0 and "whitened" in empty.columns
    # Two distinct vectors span one component.
    two = whitening.whiten(one.union(spark.createDataFrame([(3, [2.0, 2.0], None)], SCHEMA))).collect()
    assert sorted((r["vec_id"], r["component"], round(abs(r["whitened"]), 9)) for r in two) == [(1, 1, 1.0), (2, 1, 1.0), (3, 1, 1.0)]


def test_registered_query_over_its_whole_table(spark, data):
    df = queries.QUERIES["op13_whitening"](spark, data)
    assert [f.simpleString() for f in df.schema] == [
        "vec_id:bigint", "component:int", "n:bigint", "deviation:bigint", "whitened:double", "explained:double", "identity_error:double"]
    source = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    usable = [r for r in source if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    check(df.collect(), brute([(r["vec_id"], whole(r["embedding"])) for r in usable]))


def test_deviations_beyond_64_bits():
    model = whitening.Whitening(2, 1 << 40, np.array([0, 0], object), np.ones(1), np.ones((2, 1)), 1.0, 0.0)
    assert model.deviations(np.array([[1 << 30, 0], [1, 0]])) == [None, None]
    model = whitening.Whitening(2, 1 << 30, np.array([1 << 30, 0], object), np.ones(1), np.ones((2, 1)), 1.0, 0.0)
    assert model.deviations(np.array([[3, 0], [1 << 20, 5]])) == [(2 << 30) ** 2, None]


SPECTRA = {
    "wide": [1, *np.logspace(-6, -9, 63)],
    "equal": [1] * 64,
    "tied at the border": [5] * 20 + [1] * 44,
    "close": list(1 + np.arange(64) * 1e-7),
    "falling": list(2.0 ** -np.arange(64)),
    "near pair": [1, 1 - 1e-13, *np.linspace(0.5, 0.1, 62)],
    "rank three": [5, 4, 3] + [0] * 61,
    "nothing": [0] * 64,
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs(name):
    values = np.array(SPECTRA[name], float)
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(64, 64)))[0]
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.leading_pairs(matrix, 16)
    want = np.sort(values)[::-1][: min(16, int((values > 0).sum()))]
    assert len(found) == len(want)
    if len(want):
        assert np.abs(found - want).max() < 1e-13 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() < 1e-13
        assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * want[0]


def test_inertia_counts():
    rng = random.Random(1)
    x = np.random.default_rng(2).normal(size=(30, 30))
    matrix = x + x.T
    values = np.linalg.eigvalsh(matrix)
    counts = whitening.Inertia(matrix)
    for _ in range(200):
        shift = rng.uniform(-20, 20)
        assert counts.above(shift) == (values > shift).sum()
    assert whitening.Inertia(np.diag([0.0, 0.0, 3.0])).above(0.0) == 1


def test_an_interval_with_another_count_is_refused():
    with pytest.raises(ArithmeticError):
        whitening.feast(np.diag([1.0, 2.0, 3.0, 9.0]), 0.5, 3.5, 2)
