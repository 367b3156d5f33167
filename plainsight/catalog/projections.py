"""Projections."""

from pyspark.sql import functions as F

from ..functions import text
from ..operators import projection as P
from ..operators.reshape import stack
from .registry import query


@query("select_cols", "select l_shipdate, l_orderkey, l_quantity from lineitem")
def select_cols(t):
    return t.lineitem.select("l_shipdate", "l_orderkey", "l_quantity")


@query("drop_cols", "select c_custkey, c_name, c_acctbal from customer")
def drop_cols(t):
    return t.customer.drop("c_nationkey", "c_mktsegment")


@query("select_regex", "select p_brand, p_type from part")
def select_regex(t):
    return P.select_matching(t.part, "^p_[bt]")


@query(
    "rename_bulk",
    "select s_suppkey as agency_id, s_name as agency, s_nationkey as state_id, s_acctbal as balance from supplier",
)
def rename_bulk(t):
    names = {"s_suppkey": "agency_id", "s_name": "agency", "s_nationkey": "state_id", "s_acctbal": "balance"}
    return t.supplier.withColumnsRenamed(names)


@query(
    "derive_chain",
    """
    with a as (select l_orderkey, l_partkey, l_linenumber, l_tax, l_extendedprice * (1 - l_discount) as net from lineitem),
         b as (select *, net * l_tax as tax from a)
    select l_orderkey, l_partkey, l_linenumber, round(net, 6) as net, round(tax, 6) as tax, round(net + tax, 6) as gross from b
    """,
)
def derive_chain(t):
    rows = P.derive(
        t.lineitem,
        net=F.col("l_extendedprice") * (1 - F.col("l_discount")),
        tax=F.col("net") * F.col("l_tax"),
        gross=F.col("net") + F.col("tax"),
    )
    rounded = P.map_columns(rows, lambda c: F.round(c, 6), only=["net", "tax", "gross"])
    return rounded.select("l_orderkey", "l_partkey", "l_linenumber", "net", "tax", "gross")


@query(
    "across_map",
    """
    select l_orderkey, l_linenumber, l_returnflag, l_quantity / 10 as l_quantity, l_extendedprice / 10 as l_extendedprice,
           l_discount / 10 as l_discount, l_tax / 10 as l_tax
    from lineitem
    """,
)
def across_map(t):
    keep = ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return P.map_columns(t.lineitem.select(keep), lambda c: c / 10, but=keep[:3])


@query(
    "clean_names",
    """
    select s_suppkey as supplier_id, s_name as agency_name, s_nationkey as agency_name_2,
           s_acctbal as x2024_balance_percent from supplier
    """,
)
def clean_names(t):
    messy = t.supplier.toDF("Supplier ID", "Agency  Name", "agencyName", "2024 Balance (%)")
    return P.clean_names(messy)


@query(
    "tag_source",
    """
    select c_name as name, c_acctbal as balance, 'customer' as source from customer
    union all select s_name, s_acctbal, 'supplier' from supplier
    """,
)
def tag_source(t):
    buyers = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    sellers = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return stack(P.tag(buyers, source="customer"), P.tag(sellers, source="supplier"))


@query(
    "kv_to_wide",
    """
    select user_id, max(case when event_type = 'click' then value end) as click_value,
           max(case when event_type = 'purchase' then value end) as purchase_value,
           max(case when event_type = 'view' then props end) as view_props
    from events group by user_id
    """,
)
def kv_to_wide(t):
    return P.record_of(
        t.events,
        ["user_id"],
        "event_type",
        {
            "click_value": ("click", F.col("value")),
            "purchase_value": ("purchase", F.col("value")),
            "view_props": ("view", F.col("props")),
        },
    )


@query(
    "drop_first_per_group",
    """
    select user_id, event_id, event_type from
      (select *, row_number() over (partition by user_id order by event_id) as rn from events)
    where rn > 1
    """,
)
def drop_first_per_group(t):
    return P.drop_first_per_group(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query(
    "format_display",
    """
    select c_custkey, '$' || format('{:,.2f}', c_acctbal) as balance, format('{:,}', c_custkey * 1000) as big,
           format('{:,.1f}', c_nationkey * 100 / 32.0) || '%' as share
    from customer where c_acctbal >= 0
    union all
    select c_custkey, '-$' || format('{:,.2f}', -c_acctbal), format('{:,}', c_custkey * 1000),
           format('{:,.1f}', c_nationkey * 100 / 32.0) || '%'
    from customer where c_acctbal < 0
    """,
)
def format_display(t):
    return t.customer.select(
        "c_custkey",
        text.dollars("c_acctbal").alias("balance"),
        text.grouped(F.col("c_custkey") * 1000).alias("big"),
        text.percent(F.col("c_nationkey") / 32.0).alias("share"),
    )
