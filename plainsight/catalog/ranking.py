"""Windows, ranking, sort, limit, sample."""

from pyspark.sql import functions as F

from ..functions import missing as M
from ..operators import ranking as R
from .registry import query


@query(
    "row_number_group",
    """
    select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as row_no from events
    """,
)
def row_number_group(t):
    rows = t.events.select("user_id", "event_id", "value")
    return R.number_in_group(rows, ["user_id"], M.desc("value"), F.asc("event_id")).select("user_id", "event_id", "row_no")


@query(
    "row_number_global",
    "select s_suppkey, s_acctbal, row_number() over (order by s_acctbal desc, s_suppkey) as row_no from supplier",
)
def row_number_global(t):
    rows = R.number_rows(t.supplier.select("s_suppkey", "s_acctbal"), M.desc("s_acctbal"), F.asc("s_suppkey"))
    return rows.select("s_suppkey", "s_acctbal", "row_no")


def _top_orders(t, k):
    rows = t.orders.select(F.year("o_orderdate").alias("year"), "o_orderkey", "o_totalprice")
    return R.top_per_group(rows, ["year"], k, M.desc("o_totalprice"), F.asc("o_orderkey"))


_TOP = """
    select year, o_orderkey, o_totalprice from
      (select year(o_orderdate) as year, o_orderkey, o_totalprice,
              row_number() over (partition by year(o_orderdate) order by o_totalprice desc, o_orderkey) as rn from orders)
    where rn <= {}
    """


@query("top1_per_group", _TOP.format(1))
def top1_per_group(t):
    return _top_orders(t, 1)


@query("topk_per_group", _TOP.format(10))
def topk_per_group(t):
    return _top_orders(t, 10)


@query(
    "top_n_ties",
    """
    select l_orderkey, l_partkey, l_quantity from (select *, rank() over (order by l_quantity desc) as r from lineitem) where r <= 10
    """,
)
def top_n_ties(t):
    return R.top_n_ties(t.lineitem.select("l_orderkey", "l_partkey", "l_quantity"), "l_quantity", 10)


@query(
    "top_n_ties_per_group",
    """
    select l_returnflag, l_orderkey, l_partkey, l_quantity from
      (select *, rank() over (partition by l_returnflag order by l_quantity) as r from lineitem) where r <= 5
    """,
)
def top_n_ties_per_group(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey", "l_quantity")
    return R.top_per_group_ties(rows, ["l_returnflag"], "l_quantity", 5, largest=False)


@query("top_n_noties", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def top_n_noties(t):
    return R.top_n(t.orders.select("o_orderkey", "o_totalprice"), 10, M.desc("o_totalprice"), F.asc("o_orderkey"))


@query("sort_desc", "select c_custkey, c_acctbal from customer order by c_acctbal desc nulls last, c_custkey")
def sort_desc(t):
    return t.customer.select("c_custkey", "c_acctbal").orderBy(M.desc("c_acctbal"), "c_custkey")


@query("sort_multi", "select o_orderpriority, o_orderkey, o_totalprice from orders order by 1 asc, 3 desc, 2")
def sort_multi(t):
    rows = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rows.orderBy(M.asc("o_orderpriority"), M.desc("o_totalprice"), "o_orderkey")


@query("sort_expr", "select p_partkey, p_size, p_retailprice from part order by p_size + p_retailprice, p_partkey")
def sort_expr(t):
    rows = t.part.select("p_partkey", "p_size", "p_retailprice")
    return rows.orderBy(M.asc(F.col("p_size") + F.col("p_retailprice")), "p_partkey")


@query("top_k_global", "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 5")
def top_k_global(t):
    return R.top_n(t.customer.select("c_custkey", "c_acctbal"), 5, M.desc("c_acctbal"), F.asc("c_custkey"))


@query(
    "head_ordered",
    "select distinct p_name, p_brand from part where p_size > 25 order by p_name, p_brand limit 20",
)
def head_ordered(t):
    rows = t.part.where(F.col("p_size") > 25).select("p_name", "p_brand").distinct()
    return R.top_n(rows, 20, F.asc("p_name"), F.asc("p_brand"))


@query("sample_n", "select o_orderkey, o_totalprice from orders order by md5('42|' || o_orderkey), o_orderkey limit 10")
def sample_n(t):
    return R.sample_n(t.orders.select("o_orderkey", "o_totalprice"), 10, ["o_orderkey"])
