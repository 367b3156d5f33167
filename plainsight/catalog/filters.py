"""Filters and predicates."""

from pyspark.sql import functions as F

from ..functions import missing as M
from ..operators import joins as J
from .registry import query


@query("filter_cmp", "select c_custkey, c_acctbal from customer where c_acctbal >= 5000")
def filter_cmp(t):
    return t.customer.where(F.col("c_acctbal") >= 5000).select("c_custkey", "c_acctbal")


@query(
    "filter_conj",
    "select l_orderkey, l_quantity from lineitem where l_returnflag = 'A' and l_linestatus = 'F' and l_quantity = 10",
)
def filter_conj(t):
    wanted = (F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") == 10)
    return t.lineitem.where(wanted).select("l_orderkey", "l_quantity")


@query(
    "filter_ne_chain",
    """
    select o_orderkey, o_orderpriority from orders
    where o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' and o_orderpriority <> '5-LO'
    """,
)
def filter_ne_chain(t):
    return t.orders.where(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LO")).select("o_orderkey", "o_orderpriority")


@query("filter_in", "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def filter_in(t):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query(
    "filter_not_in_keepnull",
    """
    with x as (select c_custkey, case when c_mktsegment <> 'HOUSEHOLD' then c_mktsegment end as segment from customer)
    select * from x where segment is null or segment not in ('BUILDING', 'MACHINERY')
    """,
)
def filter_not_in_keepnull(t):
    segment = F.when(F.col("c_mktsegment") != "HOUSEHOLD", F.col("c_mktsegment"))
    rows = t.customer.select("c_custkey", segment.alias("segment"))
    return rows.where(M.not_in("segment", ["BUILDING", "MACHINERY"]))


@query(
    "filter_notnull",
    """
    select c_custkey, o_orderkey from customer left join
      (select * from orders where o_orderstatus = 'F' and o_totalprice > 300000) on c_custkey = o_custkey
    where o_orderkey is not null
    """,
)
def filter_notnull(t):
    big = t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
    rows = J.join(t.customer, big, {"c_custkey": "o_custkey"})
    return rows.where(F.col("o_orderkey").isNotNull()).select("c_custkey", "o_orderkey")


@query(
    "filter_not_regex",
    "select p_partkey, p_name from part where not regexp_matches(p_name, 'red|r[io]ng?$')",
)
def filter_not_regex(t):
    return t.part.where(~M.matches("p_name", "red|r[io]ng?$")).select("p_partkey", "p_name")


@query(
    "filter_between_bounds",
    """
    select p_partkey, p_retailprice from part, (select min(p_retailprice) - 0.1 as lo, max(p_retailprice) + 0.1 as hi
      from part where p_brand = 'Brand#7' and p_type = 'PROMO') b
    where p_retailprice >= lo and p_retailprice <= hi
    """,
)
def filter_between_bounds(t):
    part = t.part
    bounds = part.where((F.col("p_brand") == "Brand#7") & (F.col("p_type") == "PROMO")).agg(
        (F.min("p_retailprice") - 0.1).alias("lo"), (F.max("p_retailprice") + 0.1).alias("hi")
    )
    price = F.col("p_retailprice")
    inside = (price >= bounds.select("lo").scalar()) & (price <= bounds.select("hi").scalar())
    return part.where(inside).select("p_partkey", "p_retailprice")


@query(
    "semi_band",
    """
    select p_partkey, p_retailprice from part x where exists (
      select 1 from part a where a.p_name = 'red ring' and a.p_type = 'PROMO' and abs(x.p_retailprice - a.p_retailprice) <= 5)
    """,
)
def semi_band(t):
    anchors = t.part.where((F.col("p_name") == "red ring") & (F.col("p_type") == "PROMO"))
    return J.semi_band(t.part.select("p_partkey", "p_retailprice"), "p_retailprice", anchors, "p_retailprice", 5.0)


@query(
    "filter_date_sentinel",
    """
    with x as (select o_orderkey, case when o_orderstatus = 'P' then date '9999-12-31' else cast(o_orderdate as date) end as d from orders)
    select o_orderkey, strftime(d, '%Y-%m-%d') as started from x where d >= date '2000-01-01' and d <> date '9999-12-31'
    """,
)
def filter_date_sentinel(t):
    never = F.to_date(F.lit("9999-12-31"))
    started = F.when(F.col("o_orderstatus") == "P", never).otherwise(F.to_date("o_orderdate"))
    rows = t.orders.select("o_orderkey", started.alias("d"))
    rows = rows.where((F.col("d") >= F.to_date(F.lit("2000-01-01"))) & (F.col("d") != never))
    return rows.select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("started"))


@query(
    "having",
    "select l_partkey, sum(l_quantity) as qty from lineitem group by l_partkey having sum(l_quantity) > 800",
)
def having(t):
    return t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty")).where(F.col("qty") > 800)


@query(
    "filter_nonzero",
    "select l_orderkey, l_partkey, round(l_extendedprice * l_discount, 4) as saved from lineitem where l_extendedprice * l_discount <> 0",
)
def filter_nonzero(t):
    saved = F.col("l_extendedprice") * F.col("l_discount")
    return t.lineitem.where(saved != 0).select("l_orderkey", "l_partkey", F.round(saved, 4).alias("saved"))
