import math

import numpy as np
import pytest
from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plainsight.functions import conditions as C
from plainsight.functions import geometry as G
from plainsight.functions import missing as M
from plainsight.functions import numbers as N
from plainsight.functions import text
from plainsight.functions.similarity import jaro, jaro_block


def column(spark, items, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {kind}").coalesce(1)


def apply(spark, items, f, kind="string"):
    return [r[0] for r in column(spark, items, kind).orderBy("i").select(f(F.col("x"))).collect()]


def test_ratio_by_zero(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 2.0), (None, 1.0), (1.0, None)], "a double, b double")
    got = [r[0] for r in rows.select(M.ratio("a", "b")).collect()]
    assert math.isnan(got[0])
    assert got[1:] == [math.inf, -math.inf, 0.5, None, None]


def test_sum_and_mean_of_nothing(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", 1.0), ("b", None), ("c", 2.0)], "g string, x double")
    got = rows.groupBy("g").agg(M.sum0("x"), F.avg("x"), M.mean_strict("x"), M.sum_strict("x")).orderBy("g")
    assert values(got) == [("a", 0.0, None, None, None), ("b", 1.0, 1.0, None, None), ("c", 2.0, 2.0, 2.0, 2.0)]


def test_not_in_keeps_null(spark):
    rows = column(spark, ["a", None, "b"])
    assert values(rows.where(M.not_in("x", ["a"])), "x") == [(None,), ("b",)]
    assert values(rows.where(M.is_in("x", ["a"])), "x") == [("a",)]
    assert values(rows.where(~M.matches("x", "^a")), "x") == [(None,), ("b",)]


def test_missing_sorts_last_both_ways(spark):
    rows = column(spark, [float("nan"), 1.0, None, 2.0], "double")
    up = [r[0] for r in rows.orderBy(*M.asc_missing_last("x")).select("x").collect()]
    down = [r[0] for r in rows.orderBy(*M.desc_missing_last("x")).select("x").collect()]
    assert up[:2] == [1.0, 2.0] and down[:2] == [2.0, 1.0]


def test_title_case(spark):
    given_ = ["STATEN-ISLAND", "o'brien (acting)/chief", "", None, "  two  words ", "élan vital"]
    want = ["Staten-Island", "O'brien (Acting)/Chief", "", None, "  Two  Words ", "Élan Vital"]
    assert apply(spark, given_, text.title_case) == want


def test_numbers_as_text(spark):
    given_ = ["1,234", "-5.2%", "$1,000.50", "-", "abc", None]
    assert apply(spark, given_, text.parse_number) == [1234.0, -5.2, 1000.5, None, None, None]
    assert apply(spark, given_, text.strip_to_number) == [1234.0, 5.2, 1000.5, None, None, None]
    assert apply(spark, given_, text.comma_number) == [1234.0, None, None, None, None, None]
    assert apply(spark, given_, text.dash_to_zero) == [0.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert apply(spark, ["75%", "5", "x%", None], text.percent_to_ratio) == [0.75, 0.05, None, None]


def test_capture_and_slug(spark):
    assert apply(spark, ["a:b:c", "a:b", None], text.last_uri_part) == ["c", None, None]
    states = ["New York", "Washington", None]
    assert apply(spark, states, lambda c: text.slug(c, {"Washington": "Washington_(state)"})) == ["New_York", "Washington_(state)", None]


def test_display(spark):
    assert apply(spark, [1234.5, -2.0, None], text.dollars, "double") == ["$1,234.50", "-$2.00", None]
    assert apply(spark, [1234567.0], text.grouped, "double") == ["1,234,567"]


def test_clean_names():
    assert text.clean_names(["Job Title", "job title", "2024 Total (%)", "jobTitle", ""]) == [
        "job_title", "job_title_2", "x2024_total_percent", "job_title_3", "x",
    ]


def test_cut_is_right_closed(spark):
    cut = lambda c: C.cut_right(c, [0, 25, 75, 100], ["Low", "Medium", "High"])
    got = apply(spark, [0.0, 25.0, 25.1, 75.0, 100.0, 101.0, None], cut, "double")
    assert got == ["Low", "Low", "Medium", "Medium", "High", None, None]


def test_buckets_put_missing_first(spark):
    got = apply(spark, [float("nan"), None, 1.9, 2.0, 4.0, 4.1], lambda c: C.low_mid_high(c, 2, 4), "double")
    assert got == ["Unknown", "Unknown", "Small", "Medium", "Medium", "Large"]


def test_recode_and_if_else(spark):
    assert apply(spark, ["a", "z", None], lambda c: C.recode(c, {"a": "A"}, "?")) == ["A", "?", "?"]
    assert apply(spark, [1, None, 3], lambda c: C.if_else(c > 2, "y", "n"), "int") == ["n", None, "y"]


def test_rounding_and_bands(spark):
    assert apply(spark, [0.5, 1.5, 2.5, -0.5], N.round_even, "double") == [0.0, 2.0, 2.0, 0.0]
    assert apply(spark, [1999, 2000, -1], N.decade, "int") == [1990, 2000, -10]


def test_weighted_sum_propagates_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, None)], "a double, b double")
    assert values(rows.select(N.weighted_sum({"a": 3, "b": 0}))) == [(3.0,), (None,)]
    assert values(rows.select(N.row_sum(["a", "b"]))) == [(3.0,), (1.0,)]


def test_tiered_pay(spark):
    rows = spark.createDataFrame([(50.0, 10.0, 2.0, "x"), (2600.0, 75.0, 0.0, "x"), (9.0, 1.0, 1.0, "top"), (None, 1.0, 1.0, "x")], "b double, h double, o double, p string")
    assert values(rows.select(N.tiered_pay("b", "h", "o", F.col("p") == "top"))) == [(650.0,), (100.0,), (9.0,), (None,)]


def plain_jaro(a: str, b: str) -> float:
    if not a and not b:
        return 1.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    second = [ch for ch, hit in zip(b, used) if hit]
    m = len(first)
    if m == 0:
        return 0.0
    t = sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcde ", max_size=12), st.text("abcdeé", max_size=12)), min_size=1, max_size=20))
def test_jaro_block(pairs):
    got = jaro_block([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [plain_jaro(a, b) for a, b in pairs])


def test_jaro_column(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("abc", "xyz"), (None, "a"), ("", ""), ("a" * 6000, "a" * 6000)], "a string, b string")
    got = [r[0] for r in rows.select(jaro("a", "b")).collect()]
    assert got[0] == pytest.approx(17 / 18) and got[1:] == [0.0, None, 1.0, 1.0]


def ring(*points):
    return [[{"x": float(x), "y": float(y)} for x, y in points]]


def test_centroid_and_affine(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    hole = [(1, 0), (1, 1), (2, 1), (2, 0), (1, 0)]
    shapes = [ring(*square), ring(*square[::-1]), ring(*square) + ring(*hole), [], None]
    kind = "array<array<struct<x: double, y: double>>>"
    got = apply(spark, shapes, G.centroid, kind)
    assert got[0] == (1.0, 1.0) and got[1] == (1.0, 1.0)
    assert got[2].x == pytest.approx(2.5 / 3) and got[2].y == pytest.approx(3.5 / 3)
    assert got[3:] == [None, None]
    moved = apply(spark, shapes[:1], lambda c: G.centroid(G.affine(c, F.lit(0.5), F.lit(10.0), F.lit(-1.0))), kind)
    assert moved == [(10.5, -0.5)]


def test_parse_number_that_starts_with_its_point(spark):
    rows = spark.createDataFrame([(".5",), ("-.25",), ("x1,234.5",), ("v.",), ("7.",)], "x string")
    assert [r[0] for r in rows.select(text.parse_number("x")).collect()] == [0.5, -0.25, 1234.5, None, 7.0]
