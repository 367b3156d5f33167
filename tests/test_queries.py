import duckdb
import pytest
from conftest import plan_of

import __spark_entry__ as entry
from check import TABLES, rows
from plainsight.catalog import ORACLES
from plainsight.catalog import QUERIES as NAMES

QUERIES = {name: f for name, f in entry.queries().items() if name in NAMES}


@pytest.fixture(scope="module")
def db(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    return connection


def test_names():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, data, db, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = db.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows(columns, cursor.fetchall())


# No query may compare all pairs, whatever the sizes.
@pytest.mark.parametrize("name", ["fuzzy_join", "semi_band", "band_join", "cooccurrence", "h2_key_tempo", "scalar_bounds", "job_match", "pl_final"])
def test_no_all_pairs(spark, data, name):
    plan = plan_of(QUERIES[name](spark, data))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["top1_per_group", "topk_per_group", "distinct_keep_all", "quota_per_class", "pay_biggest_agency"])
def test_limit_before_shuffle(spark, data, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, data))


@pytest.mark.parametrize("name", ["top_k_global", "top_n_noties", "preview_n", "pay_agency_avg", "el_top_votes"])
def test_top_k_without_sort(spark, data, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, data))


@pytest.mark.parametrize(
    "name, read",
    [("filter_cmp", "c_custkey:bigint,c_acctbal:double"), ("filter_in", "c_custkey:bigint,c_mktsegment:string"), ("having", "l_partkey:bigint,l_quantity:double")],
)
def test_columns_are_pruned(spark, data, name, read):
    assert f"ReadSchema: struct<{read}>" in plan_of(QUERIES[name](spark, data))


def test_filters_reach_the_scan(spark, data):
    assert "GreaterThanOrEqual(c_acctbal,5000.0)" in plan_of(QUERIES["filter_cmp"](spark, data))
    assert "In(c_mktsegment, [BUILDING,MACHINERY])" in plan_of(QUERIES["filter_in"](spark, data))
