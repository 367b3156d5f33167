import itertools
import random
from collections import Counter

import numpy as np
import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F
from test_functions import plain_jaro

from plainsight.functions import missing as M
from plainsight.operators import aggregates as A
from plainsight.operators import joins as J
from plainsight.operators import nested as X
from plainsight.operators import projection as P
from plainsight.operators import ranking as R
from plainsight.operators import reshape as S


def hot(n=3000, seed=1):
    """(key, value) rows in which one key holds a third."""
    r = random.Random(seed)
    return [(1 if i % 3 == 0 else r.randint(2, 40), round(r.uniform(0, 100), 2)) for i in range(n)]


def test_null_keys_match(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (None, "r")], "k int, x string")
    left = sorted(values(J.join(a, b, ["k"])), key=str)
    assert left == sorted([(1, "a", "p"), (None, "b", "q"), (None, "b", "r"), (3, "c", None)], key=str)
    assert J.join(a, b, ["k"]).columns == ["k", "x_x", "x_y"]
    assert sorted(values(J.join(a, b, ["k"], few=True)), key=str) == left
    assert values(J.anti(a, b, ["k"])) == [(3, "c")]
    assert sorted(values(J.semi(a, b, ["k"])), key=str) == [(1, "a"), (None, "b")]
    assert values(J.join(a, b, ["k"], "inner", null_matches=False)) == [(1, "a", "p")]


def test_left_join_with_hot_right_key(spark):
    rows = hot()
    right = spark.createDataFrame(rows, "k int, v double")
    left = spark.createDataFrame([(k,) for k in range(1, 60)], "k int")
    got = J.join(left, right, ["k"])
    found = {k for k, _ in rows}
    assert got.count() == len(rows) + len(set(range(1, 60)) - found)
    assert got.where("v is null").count() == len(set(range(1, 60)) - found)


def test_small_is_checked(spark):
    table = spark.range(50).toDF("k")
    assert "BroadcastHashJoin" in plan_of(spark.range(1000).toDF("k").join(J.small(table), "k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan_of(spark.range(1000).toDF("k").join(J.small(table, max_bytes=100), "k"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cooccurrence_against_pairs(spark):
    r = random.Random(3)
    members = [(r.randint(0, 30), r.randint(0, 12)) for _ in range(400)]
    anchors = [3, 5]
    want = {}
    for (c1, a), (c2, b) in itertools.product(members, members):
        if c1 == c2 and a in anchors and b not in anchors:
            want[b] = want.get(b, 0) + 1
    got = J.cooccurrence(
        spark.createDataFrame(members, "c int, i int"), spark.createDataFrame([(a,) for a in anchors], "i int"), "c", "i", ["i"]
    )
    assert dict(values(got)) == want


@pytest.mark.parametrize("width", [0.1, 0.3, 5.0])
def test_bands_against_pairs(spark, width):
    r = random.Random(4)
    xs = [round(r.uniform(-20, 20), 1) for _ in range(200)] + [None]
    anchors = [round(r.uniform(-20, 20), 1) for _ in range(8)] + [None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    marks = spark.createDataFrame([(a,) for a in anchors], "a double")
    near = [(i, x, a) for i, x in enumerate(xs) for a in anchors if None not in (x, a) and abs(x - a) <= width]
    assert sorted(values(J.semi_band(rows, "x", marks, "a", width), "i")) == sorted({(i,) for i, _, _ in near})
    assert sorted(values(J.band_join(rows, marks, "x", "a", width), "i", "x", "a")) == sorted(near)


@pytest.mark.parametrize("max_dist", [0.1, 0.25, 0.4, 0.6])
def test_fuzzy_pairs_against_all_pairs(spark, max_dist):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefg é😀") for _ in range(r.randint(0, 11)))
    left = [word() for _ in range(70)] + ["", None, "aaaa", "banana"]
    right = [word() for _ in range(60)] + ["", None, "aaab", "ananab"]
    got = J.fuzzy_pairs(
        spark.createDataFrame([(x,) for x in left], "t string"), spark.createDataFrame([(x,) for x in right], "t string"), max_dist
    )
    pairs = itertools.product({x for x in left if x is not None}, {x for x in right if x is not None})
    want = {(a, b) for a, b in pairs if round(plain_jaro(a, b), 9) >= round(1 - max_dist, 9)}
    found = values(got, "left_text", "right_text")
    assert len(found) == len(set(found)) and set(found) == want
    plan = plan_of(got)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.count("ArrowEvalPython") == 1


def test_fuzzy_join_suffixes(spark):
    a = spark.createDataFrame([("cook", 1), ("cook", 2), ("nurse", 3)], "job string, n int")
    b = spark.createDataFrame([("cooks", 7), ("pilot", 8)], "job string, n int")
    got = J.fuzzy_join(a, b, "job", "job", 0.2)
    assert sorted(values(got, "job_x", "n_x", "job_y", "n_y")) == [("cook", 1, "cooks", 7), ("cook", 2, "cooks", 7)]
    with pytest.raises(ValueError):
        J.fuzzy_pairs(a, b, 0.7)


def test_ties(spark):
    rows = spark.createDataFrame([(x,) for x in [5, 5, 4, 4, 3]], "x int")
    assert sorted(values(R.top_n_ties(rows, "x", 3))) == [(4,), (4,), (5,), (5,)]
    assert len(values(R.top_n(rows, 3, M.desc("x")))) == 3
    assert sorted(values(R.top_n_ties(rows, "x", 1, largest=False))) == [(3,)]
    few = spark.createDataFrame([(1,), (None,), (None,)], "x int")
    assert R.top_n_ties(few, "x", 1).count() == 1 and R.top_n_ties(few, "x", 2).count() == 3


def test_numbering_with_a_hot_group(spark):
    rows = [(k, v, i) for i, (k, v) in enumerate(hot())]
    table = spark.createDataFrame(rows, "k int, v double, i int").repartition(7)
    by_all = sorted(rows, key=lambda t: (-t[1], t[2]))
    got = dict(values(R.number_rows(table, M.desc("v"), F.asc("i")), "i", "row_no"))
    assert got == {i: n for n, (_, _, i) in enumerate(by_all, 1)}
    want, seen = {}, {}
    for k, _, i in by_all:
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert dict(values(R.number_in_group(table, ["k"], M.desc("v"), F.asc("i")), "i", "row_no")) == want


def test_quantiles_with_a_hot_group(spark):
    rows = hot()
    table = spark.createDataFrame([*rows, (99, None), (98, 4.0)], "k int, v double").repartition(5)
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = {r[0]: r[1:] for r in values(A.quantiles(table, ["k"], "v", probs))}
    assert set(got) == {k for k, _ in rows} | {98}
    for k in {k for k, _ in rows}:
        assert got[k] == pytest.approx(tuple(np.quantile([v for j, v in rows if j == k], list(probs.values()))))
    box = {r["k"]: r for r in A.five_numbers(table, ["k"], "v").collect()}
    mine = np.array([v for j, v in rows if j == 1])
    q1, q3 = np.quantile(mine, [0.25, 0.75])
    inside = mine[(mine >= q1 - 1.5 * (q3 - q1)) & (mine <= q3 + 1.5 * (q3 - q1))]
    assert box[1]["whisker_low"] == inside.min() and box[1]["whisker_high"] == inside.max()
    assert box[1]["outliers"] == len(mine) - len(inside)
    whole = A.summary(table, "v").first()
    everything = [v for _, v in rows] + [4.0]
    assert whole["median"] == pytest.approx(np.median(everything)) and whole["mean"] == pytest.approx(np.mean(everything))


def test_group_mode_and_rarest(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("b", "z"), ("b", "y"), ("b", None)], "g string, v string")
    assert sorted(values(A.group_mode(rows, ["g"], "v"))) == [("a", "x", 1), ("b", "z", 2)]
    assert values(A.rarest(rows.where("v is not null"), "v")) == [("x", 1)]


def test_quota_keeps_the_limit_before_the_shuffle(spark):
    rows = spark.createDataFrame([(c, i) for c in "abc" for i in range(5)], "c string, i int")
    got = A.quota_per_class(rows, "c", {"a": 2, "b": 4}, [F.asc("i")])
    assert sorted(values(got)) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("b", 2), ("b", 3)]
    assert "WindowGroupLimit" in plan_of(got)
    assert "WindowGroupLimit" in plan_of(R.top_per_group(rows, ["c"], 2, F.asc("i")))


def test_growth_and_constant(spark):
    rows = spark.createDataFrame([(1, 10.0, 3.0), (2, 15.0, 4.0), (2, 5.0, 4.0)], "y int, v double, c double")
    assert values(A.growth(rows, "y", F.col("v"), 1, 2)) == [(10.0, 20.0, 1.0)]
    assert sorted(values(A.max_minus_constant(rows, ["y"], "v", "c", "d"))) == [(1, 7.0), (2, 11.0)]
    with pytest.raises(Exception, match="differs inside a group"):
        A.max_minus_constant(rows, [], "v", "c", "d").collect()


def test_mean_of_ratios_skips_undefined(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (3.0, 2.0), (None, 1.0)], "a double, b double")
    assert values(rows.agg(A.mean_of_ratios("a", "b"))) == [(1.0,)]


def test_histograms(spark):
    rows = spark.createDataFrame([("a", float(x), float(x)) for x in [0, 5, 5.1, 10, 15]] + [("b", 2.0, 3.0)], "f string, x double, y double")
    assert sorted(values(A.histogram_width(rows, "x", 10.0))) == [(0, 3), (1, 3)]
    assert sorted(values(A.histogram_width(rows, "x", 10.0, 0, 10, boundary=0.0))) == [(0, 1), (1, 4)]
    assert sum(n for _, n in values(A.histogram_bins(rows, "x", 4))) == 6
    assert values(A.histogram_bins(rows.where("f = 'b'"), "x", 4)) == [(0, 1)]
    grid = values(A.histogram_2d(rows, "f", "x", "y", (3, 3), free_x=True))
    assert ("b", 1, 1, 1) in grid and sum(n for *_, n in grid) == 6


def test_projection_operators(spark):
    rows = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 5, 4.0)], "g string, i int, Value double")
    assert P.select_matching(rows, "^[A-Z]").columns == ["Value"]
    assert sorted(values(P.drop_first_per_group(rows, ["g"], "i"))) == [("a", 2, 3.0)]
    assert P.numeric_columns(rows, but=["i"]) == ["Value"]
    assert values(P.derive(rows, a=F.col("i") + 1, b=F.col("a") * 2), "b") == [(4,), (6,), (12,)]
    record = P.record_of(rows, ["g"], "i", {"one": (1, F.col("Value")), "five": (5, F.col("Value"))})
    assert sorted(values(record)) == [("a", 2.0, None), ("b", None, 4.0)]


def test_reshape(spark):
    rows = spark.createDataFrame([(1, "x", 2.0), (1, "y", 3.0), (2, "x", 4.0)], "i int, k string, v double")
    wide = S.pivot_wider(rows, ["i"], "k", {"x": "ex", "y": "why"}, F.sum("v"))
    assert sorted(values(wide, "i", "ex", "why")) == [(1, 2.0, 3.0), (2, 4.0, None)]
    long = S.pivot_longer(wide, ["i"], ["ex", "why"], "k", "v")
    assert sorted(values(long), key=str) == [(1, "ex", 2.0), (1, "why", 3.0), (2, "ex", 4.0), (2, "why", None)]
    both = S.stack(rows.select("i"), rows.select("v", "i"))
    assert both.columns == ["i", "v"] and both.count() == 6


def test_rectangle_skips_empty(spark):
    inner = [
        ("a", [{"v": 1}, None, {"v": 2}]),
        ("b", []),
        ("c", None),
    ]
    kind = "ps array<struct<n: string, ts: array<struct<v: int>>>>"
    rows = spark.createDataFrame([([{"n": n, "ts": ts} for n, ts in inner],), (None,)], kind)
    assert values(X.rectangle(rows, "ps", ["n"], "ts")) == [("a", 1, 1), ("a", 2, 2)]


def test_explode_names(spark):
    rows = spark.createDataFrame([(1, "['A', 'B C']"), (2, "[\"D\"]")], "i int, l string")
    assert values(X.explode_names(rows, "l", "name")) == [(1, "A"), (1, "B C"), (2, '["D"]')]


def test_lookup_first(spark):
    dim = spark.createDataFrame([("a", "second", 2), ("a", "first", 1), (None, "none", 3)], "k string, v string, o int")
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert sorted(values(J.lookup_first(rows, dim, {"x": "k"}, "v", "o")), key=str) == sorted(
        [("a", "first"), ("b", None), (None, "none")], key=str
    )


def test_sample_is_stable(spark):
    rows = spark.range(100)
    assert values(R.sample_n(rows, 5, ["id"])) == values(R.sample_n(rows.repartition(9), 5, ["id"]))
    assert values(R.sample_n(rows, 5, ["id"], seed=1)) != values(R.sample_n(rows, 5, ["id"], seed=2))


def test_sample_does_not_depend_on_the_type_of_its_key(spark):
    rows = spark.range(300).select((F.col("id") * 1_000_003 + 9_000_000_000).alias("id"))
    want = [r[0] for r in R.sample_n(rows, 20, ["id"]).collect()]
    assert max(want) > 10**9
    for kind in ("double", "decimal(20,2)", "string"):
        assert [int(r[0]) for r in R.sample_n(rows.select(F.col("id").cast(kind).alias("id")), 20, ["id"]).collect()] == want
    small = spark.range(50).select(F.col("id").cast("float").alias("id"))
    assert [int(r[0]) for r in R.sample_n(small, 5, ["id"]).collect()] == [r[0] for r in R.sample_n(spark.range(50), 5, ["id"]).collect()]
    missing = spark.createDataFrame([(None,), (1.0,)], "id double")
    assert R.sample_n(missing, 5, ["id"]).count() == 2
    with pytest.raises(Exception, match="no whole number"):
        R.sample_n(spark.createDataFrame([(1.5,), (2.0,)], "id double"), 1, ["id"]).collect()


@pytest.mark.parametrize("largest", [True, False])
def test_ties_per_group_without_a_window(spark, largest):
    rng = random.Random(7)
    groups = ["a", "b", None, "", "c"]
    rows = [(rng.choice(groups), rng.choice([1, None]), rng.choice([None, float("nan"), 0.0, -0.0, *map(float, range(6))])) for _ in range(2000)]
    rows += [("hot", 1, 5.0)] * 1000 + [("few", 1, 1.0), ("none", 1, None), ("none", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, h int, v double").repartition(7)
    for n in (1, 3, 40, 5000):
        found = R.top_per_group_ties(df, ["g", "h"], "v", n, largest)
        assert "Window" not in plan_of(found)
        by_group = {}
        for g, h, v in rows:
            by_group.setdefault((g, h), []).append(None if v is None or v != v else v + 0.0)
        want = Counter()
        for key, own in by_group.items():
            order = sorted(own, key=lambda v: (v is None, 0 if v is None else -v if largest else v))
            last = order[min(n, len(order)) - 1]
            inside = [v for v in own if last is None or (v is not None and (v >= last if largest else v <= last))]
            want.update((*key, v) for v in inside)
        got = Counter((g, h, None if v is None or v != v else v + 0.0) for g, h, v in values(found))
        assert got == want
    assert R.top_per_group_ties(df.limit(0), ["g"], "v", 3).count() == 0


def test_ties_of_text_and_of_whole_numbers(spark):
    df = spark.createDataFrame([("a", "x", 3), ("a", "y", 3), ("a", "z", 9), ("b", None, None)], "g string, s string, i int")
    assert sorted(values(R.top_per_group_ties(df, ["g"], "i", 2), "g", "i"), key=str) == [("a", 3), ("a", 3), ("a", 9), ("b", None)]
    assert sorted(values(R.top_per_group_ties(df, ["g"], "s", 1), "g", "s"), key=str) == [("a", "z"), ("b", None)]
