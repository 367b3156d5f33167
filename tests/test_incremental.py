import random

import pytest
from conftest import plan_of, values
from pyspark.sql import functions as F

from plainsight.operators import ranking as R
from plainsight.operators import sketches
from plainsight.session import scratch_dir
from plainsight.sources.manifest import Manifest, fetch_once


def test_keys_are_fetched_once_over_many_runs(spark):
    folder = scratch_dir(spark, "manifest")
    got = []
    for run, (low, high) in enumerate([(0, 300), (200, 500), (0, 520)]):
        # Each run opens the manifest anew, as another session would.
        spark.sql(f"DROP TABLE IF EXISTS {Manifest(spark, folder, {'id': 'bigint', 's': 'string'}, 4).table}")
        seen = Manifest(spark, folder, {"id": "bigint", "s": "string"}, 4)
        rows = spark.range(low, high).select((F.col("id") % 400).alias("id"), F.lit("k").alias("s"), F.col("id").alias("v"))
        rows = rows.union(spark.createDataFrame([(None, "k", 1)], "id bigint, s string, v bigint")).repartition(3)
        got += [(run, *r) for r in values(fetch_once(seen, rows, scratch_dir(spark, "fetched"), F.asc("v")), "id", "v")]
    assert sorted(got) == sorted([(0, i, i) for i in range(300)] + [(1, i, i) for i in range(300, 400)])
    # A run that was killed after storing and before its keys were added fetches them again.
    seen.new_rows(spark.createDataFrame([(1000, "k", 1)], "id int, s string, v bigint")).collect()
    assert seen.new_rows(spark.createDataFrame([(1000, "k", 1)], "id int, s string, v bigint")).count() == 1
    assert seen.new_rows(spark.createDataFrame([(1, "k", 1)], "id int, s string, v bigint")).count() == 0


def test_the_manifest_is_not_shuffled(spark):
    seen = Manifest(spark, scratch_dir(spark, "manifest"), {"id": "bigint"}, 4)
    rows = spark.range(1000)
    fetch_once(seen, rows, scratch_dir(spark, "fetched"))
    plan = plan_of(seen.new_rows(spark.range(2000)))
    # One side is brought to the buckets; the other is scanned in them.
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan, plan


def test_factor_codes(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", None, "c", "b", "", "é", "Z"]], "s string").repartition(4)
    found = R.factor_codes(df, "s", "code")
    assert sorted(values(found), key=str) == sorted(
        [("b", 4), ("a", 3), (None, None), ("c", 5), ("b", 4), ("", 1), ("é", 6), ("Z", 2)], key=str)
    given = R.factor_codes(df, "s", "code", ["c", "a"])
    assert sorted(values(given), key=str) == sorted(
        [("b", None), ("a", 2), (None, None), ("c", 1), ("b", None), ("", None), ("é", None), ("Z", None)], key=str)
    numbers = spark.range(2000).select((F.col("id") % 700 * 3).alias("x"))
    assert values(R.factor_codes(numbers, "x", "code").where("code <> x / 3 + 1")) == []
    assert R.factor_codes(df.limit(0), "s", "code").count() == 0


def test_only_offsets_of_partitions_are_in_one_window(spark):
    plan = plan_of(R.factor_codes(spark.range(100).select(F.col("id").alias("x")), "x", "code"))
    # The one window numbers a row per partition, never the levels.
    assert "Window" not in plan or "_size" in plan


def test_estimates_stay_within_their_bounds(spark):
    rng = random.Random(2)
    rows = [("hot", rng.randrange(5000), rng.gauss(0, 1)) for _ in range(20_000)]
    rows += [(g, rng.randrange(40), float(rng.randrange(10))) for g in ("a", "b") for _ in range(500)]
    rows += [("nan", None, float("nan")), ("nan", None, None)]
    df = spark.createDataFrame(rows, "g string, k int, v double").withColumn("page", F.pmod(F.xxhash64("k", "v"), F.lit(7)))
    exact = {g: [r for r in rows if r[0] == g] for g in ("hot", "a", "b")}
    for order in (df, df.repartition(5)):
        pages = sketches.summarise(order, ["page", "g"], "k", "v")
        found = {r["g"]: r for r in sketches.estimates(pages.repartition(3), ["g"], (0.1, 0.5, 0.9)).collect()}
        for g, own in exact.items():
            n = len({k for _, k, _ in own})
            assert found[g]["n"] == len(own) and abs(found[g]["n_distinct"] - n) <= sketches.COUNT_ERROR * n + 1
            for q in (0.1, 0.5, 0.9):
                value = found[g][f"q{q:g}"]
                low, high = (sum(v < value for _, _, v in own), sum(v <= value for _, _, v in own))
                assert low / len(own) - sketches.RANK_ERROR <= q <= high / len(own) + sketches.RANK_ERROR
        assert found["nan"]["n"] == 2 and found["nan"]["q0.5"] is None and found["nan"]["n_distinct"] == 0


def test_pages_are_summarised_once(spark):
    store = scratch_dir(spark, "sketches")
    df = spark.range(900).select((F.col("id") % 3).alias("page"), (F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    sketches.add_pages(spark, store, df.where("page < 2"), "page", ["g"], "k", "v")
    # Rows of known pages are not read again, even where they have changed.
    changed = df.where("page < 2").withColumn("k", F.lit(1).cast("long"))
    pages = sketches.add_pages(spark, store, changed.union(df.where("page = 2")), "page", ["g"], "k", "v")
    assert sorted(values(pages, "page", "g", "n")) == [(p, g, 150) for p in range(3) for g in range(2)]
    assert all(abs(r["n_distinct"] - 450) < 30 for r in sketches.estimates(pages, ["g"]).collect())
