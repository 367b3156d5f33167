"""Joins."""

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import query


@query(
    "left_join",
    "select c_custkey, c_name, o_orderkey, o_totalprice from customer left join orders on c_custkey = o_custkey",
)
def left_join(t):
    rows = J.join(t.customer, t.orders, {"c_custkey": "o_custkey"})
    return rows.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query(
    "left_join_chain",
    """
    select l_orderkey, l_linenumber, l_partkey, o_custkey, c_name
    from lineitem left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey
    """,
)
def left_join_chain(t):
    rows = J.join(t.lineitem, t.orders, {"l_orderkey": "o_orderkey"}, few=True)
    rows = J.join(rows, t.customer, {"o_custkey": "c_custkey"}, few=True)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "c_name")


@query(
    "inner_join",
    "select o_orderkey, o_custkey, l_partkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey",
)
def inner_join(t):
    rows = J.join(t.orders, t.lineitem, {"o_orderkey": "l_orderkey"}, "inner")
    return rows.select("o_orderkey", "o_custkey", "l_partkey", "l_quantity")


def _slice(t, year):
    spent = t.orders.where(F.year("o_orderdate") == year).groupBy("o_custkey", "o_orderpriority")
    return spent.agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "inner_join_composite",
    """
    with s as (select year(o_orderdate) as y, o_custkey, o_orderpriority, round(sum(o_totalprice), 2) as total from orders group by all)
    select a.o_custkey, a.o_orderpriority, a.total as total_x, b.total as total_y
    from s a join s b on a.o_custkey = b.o_custkey and a.o_orderpriority = b.o_orderpriority
    where a.y = 2000 and b.y = 1996
    """,
)
def inner_join_composite(t):
    return J.join(_slice(t, 2000), _slice(t, 1996), ["o_custkey", "o_orderpriority"], "inner")


@query(
    "anti_join",
    "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)",
)
def anti_join(t):
    big = t.orders.where(F.col("o_totalprice") > 300000)
    return J.anti(t.customer, big, {"c_custkey": "o_custkey"}).select("c_custkey", "c_name")


@query(
    "semi_join",
    "select p_partkey, p_name from part where p_partkey in (select l_partkey from lineitem where l_quantity = 50)",
)
def semi_join(t):
    full = t.lineitem.where(F.col("l_quantity") == 50)
    return J.semi(t.part, full, {"p_partkey": "l_partkey"}).select("p_partkey", "p_name")


@query(
    "cooccurrence",
    """
    with anchors as (select p_partkey from part where p_name in ('red ring', 'blue bolt'))
    select b.l_partkey, count(*) as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
    where a.l_partkey in (select * from anchors) and b.l_partkey not in (select * from anchors)
    group by b.l_partkey
    """,
)
def cooccurrence(t):
    anchors = t.part.where(F.col("p_name").isin("red ring", "blue bolt")).select(F.col("p_partkey").alias("l_partkey"))
    return J.cooccurrence(t.lineitem, anchors, "l_orderkey", "l_partkey", ["l_partkey"])


@query(
    "fuzzy_join",
    """
    with a as (select lower(p_name || ' ' || p_brand) as title, count(*) as n from part where p_size < 25 group by 1),
         b as (select lower(p_name) as title, count(*) as n from part where p_size >= 25 group by 1)
    select a.title as title_x, b.title as title_y, a.n as n_x, b.n as n_y, round(jaro_similarity(a.title, b.title), 6) as similarity
    from a, b where round(jaro_similarity(a.title, b.title), 9) >= 0.6
    """,
)
def fuzzy_join(t):
    def titles(rows, title):
        return rows.groupBy(F.lower(title).alias("title")).agg(F.count("*").alias("n"))

    small, large = t.part.where(F.col("p_size") < 25), t.part.where(F.col("p_size") >= 25)
    left = titles(small, F.concat_ws(" ", "p_name", "p_brand"))
    rows = J.fuzzy_join(left, titles(large, F.col("p_name")), "title", "title", 0.4)
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "join_threshold",
    """
    with y as (select year(l_shipdate) as y, avg(l_extendedprice) as usual from lineitem group by 1)
    select l_orderkey, l_partkey, year(l_shipdate) as year, l_extendedprice from lineitem join y on year(l_shipdate) = y
    where l_extendedprice >= 1.5 * usual
    """,
)
def join_threshold(t):
    rows = t.lineitem.withColumn("year", F.year("l_shipdate"))
    limits = rows.groupBy("year").agg((F.avg("l_extendedprice") * 1.5).alias("limit"))
    kept = J.at_least(rows, limits, ["year"], "l_extendedprice", "limit")
    return kept.select("l_orderkey", "l_partkey", "year", "l_extendedprice")


@query(
    "lookup_first",
    """
    select c_custkey, c_nationkey % 7 as region, f.n_name from customer left join
      (select n_regionkey, arg_min(n_name, n_nationkey) as n_name from nation group by 1) f on c_nationkey % 7 = n_regionkey
    """,
)
def lookup_first(t):
    rows = t.customer.select("c_custkey", (F.col("c_nationkey") % 7).alias("region"))
    return J.lookup_first(rows, t.nation, {"region": "n_regionkey"}, "n_name", "n_nationkey")


@query(
    "scalar_bounds",
    """
    select p_partkey, p_size, round(p_size - usual, 6) as above from part, (select avg(p_size) as usual, max(p_size) as most from part)
    where p_size > usual and p_size < most
    """,
)
def scalar_bounds(t):
    one = t.part.agg(F.avg("p_size").alias("usual"), F.max("p_size").alias("most"))
    usual, most = one.select("usual").scalar(), one.select("most").scalar()
    rows = t.part.where((F.col("p_size") > usual) & (F.col("p_size") < most))
    return rows.select("p_partkey", "p_size", F.round(F.col("p_size") - usual, 6).alias("above"))


@query(
    "band_join",
    """
    with b as (select p_brand as anchor, round(avg(p_retailprice), 4) as usual from part group by 1)
    select p_partkey, p_retailprice, anchor, usual from part join b on abs(p_retailprice - usual) <= 5
    """,
)
def band_join(t):
    usual = t.part.groupBy(F.col("p_brand").alias("anchor")).agg(F.round(F.avg("p_retailprice"), 4).alias("usual"))
    rows = t.part.select("p_partkey", "p_retailprice")
    return J.band_join(rows, usual, "p_retailprice", "usual", 5.0)
