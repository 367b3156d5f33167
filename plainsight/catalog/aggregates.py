"""Aggregation, distinct, reshape, distributions, set operations."""

from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions import numbers as N
from ..functions.conditions import cut_right
from ..operators import aggregates as A
from ..operators import ranking as R
from ..operators import reshape as S
from ..operators import sketches
from .registry import query


def _year(t):
    return t.orders.withColumn("year", F.year("o_orderdate"))


@query(
    "group_sum",
    """
    select l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) as qty, round(sum(l_extendedprice), 2) as price
    from lineitem group by all
    """,
)
def group_sum(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        M.sum0("l_quantity").alias("qty"), F.round(M.sum0("l_extendedprice"), 2).alias("price")
    )


@query("group_avg", "select o_orderpriority, round(avg(o_totalprice), 4) as mean_price from orders group by 1")
def group_avg(t):
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(
    "group_avg_strict",
    """
    select o_custkey, case when count(*) = count(case when o_orderstatus <> 'P' then 1 end) then round(avg(o_totalprice), 4) end as mean_price,
           round(avg(case when o_orderstatus <> 'P' then o_totalprice end), 4) as known_mean
    from orders group by 1
    """,
)
def group_avg_strict(t):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.withColumn("known", known).groupBy("o_custkey").agg(
        F.round(M.mean_strict("known"), 4).alias("mean_price"), F.round(F.avg("known"), 4).alias("known_mean")
    )


@query(
    "group_minmax",
    "select o_custkey, min(o_totalprice) as lowest, max(o_totalprice) as highest from orders group by 1",
)
def group_minmax(t):
    return t.orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lowest"), F.max("o_totalprice").alias("highest"))


@query("group_count", "select year(o_orderdate) as year, o_orderstatus, count(*) as n from orders group by 1, 2")
def group_count(t):
    return _year(t).groupBy("year", "o_orderstatus").agg(F.count("*").alias("n"))


@query("count_sorted", "select l_partkey, l_returnflag, count(*) as n from lineitem group by 1, 2 order by n desc, 1, 2")
def count_sorted(t):
    return A.count_sorted(t.lineitem, "l_partkey", "l_returnflag")


@query(
    "count_distinct",
    """
    select (select count(distinct l_partkey) from lineitem) as parts, (select count(distinct l_suppkey) from lineitem) as suppliers
    """,
)
def count_distinct(t):
    parts = A.count_values(t.lineitem, "l_partkey")
    return parts.select(
        F.col("n").alias("parts"), A.count_values(t.lineitem, "l_suppkey").scalar().alias("suppliers")
    )


@query(
    "sketch_estimates",
    """
    select l_returnflag, count(*) as n, count(distinct l_partkey) as exact_distinct, true as distinct_within, true as median_within
    from lineitem group by 1
    """,
)
def sketch_estimates(t):
    """Estimates from summaries per ship year, merged; beside the exact figures they are held against."""
    rows = t.lineitem.withColumn("page", F.year("l_shipdate"))
    pages = sketches.summarise(rows, ["page", "l_returnflag"], "l_partkey", "l_extendedprice")
    found = sketches.estimates(pages, ["l_returnflag"]).withColumnRenamed("l_returnflag", "flag")
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact_distinct"))
    both = exact.join(found, F.col("l_returnflag") == F.col("flag"))
    ranks = t.lineitem.join(found.select("flag", F.col("`q0.5`").alias("median")), F.col("l_returnflag") == F.col("flag"))
    below = F.avg((F.col("l_extendedprice") <= F.col("median")).cast("double"))
    ranks = ranks.groupBy("flag").agg((F.abs(below - 0.5) <= sketches.RANK_ERROR + 0.01).alias("median_within"))
    error = F.abs(F.col("n_distinct") - F.col("exact_distinct")) / F.col("exact_distinct")
    return both.join(ranks, "flag").select("l_returnflag", "n", "exact_distinct", (error <= sketches.COUNT_ERROR).alias("distinct_within"), "median_within")


@query(
    "string_agg_distinct",
    """
    select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities from orders group by 1
    """,
)
def string_agg_distinct(t):
    return t.orders.groupBy("o_custkey").agg(A.join_distinct("o_orderpriority").alias("priorities"))


@query(
    "global_stats",
    """
    select round(avg(o_totalprice), 4) as mean, min(o_totalprice) as min, max(o_totalprice) as max,
           round(median(o_totalprice), 4) as median from orders
    """,
)
def global_stats(t):
    return A.summary(t.orders, "o_totalprice").select(
        F.round("mean", 4).alias("mean"), "min", "max", F.round("median", 4).alias("median")
    )


@query(
    "weighted_avg",
    """
    select l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) as price from lineitem group by 1
    """,
)
def weighted_avg(t):
    price = A.weighted_mean("l_extendedprice", "l_quantity")
    return t.lineitem.groupBy("l_returnflag").agg(F.round(price, 4).alias("price"))


@query(
    "group_mode",
    """
    with c as (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2)
    select o_custkey, o_orderpriority as mode, n from
      (select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as rn from c) where rn = 1
    """,
)
def group_mode(t):
    return A.group_mode(t.orders, ["o_custkey"], "o_orderpriority")


@query("rarest_category", "select p_name, count(*) as n from part group by 1 order by n, p_name limit 1")
def rarest_category(t):
    return A.rarest(t.part, "p_name")


@query(
    "corr_by_year",
    """
    with y as (select year(o_orderdate) as y, count(*) as n, sum(o_totalprice) as total from orders group by 1)
    select round(corr(n, total), 6) as corr from y
    """,
)
def corr_by_year(t):
    yearly = _year(t).groupBy("year").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return yearly.agg(F.round(F.corr("n", "total"), 6).alias("corr"))


@query(
    "sum_all_numeric",
    """
    select l_returnflag, sum(l_linenumber) as l_linenumber, sum(l_quantity) as l_quantity,
           round(sum(l_extendedprice), 2) as l_extendedprice, round(sum(l_discount), 2) as l_discount, round(sum(l_tax), 2) as l_tax
    from lineitem group by 1
    """,
)
def sum_all_numeric(t):
    sums = A.sum_all_numeric(t.lineitem, ["l_returnflag"], but=["l_orderkey", "l_partkey", "l_suppkey"])
    for c in ("l_extendedprice", "l_discount", "l_tax"):
        sums = sums.withColumn(c, F.round(c, 2))
    return sums


@query(
    "row_sum",
    """
    select l_orderkey, l_partkey, round(coalesce(l_quantity, 0) + coalesce(case when l_discount > 0 then l_discount end, 0) + l_tax, 4) as total
    from lineitem
    """,
)
def row_sum(t):
    rows = t.lineitem.withColumn("l_discount", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    total = N.row_sum(["l_quantity", "l_discount", "l_tax"])
    return rows.select("l_orderkey", "l_partkey", F.round(total, 4).alias("total"))


@query(
    "ratio_of_sums",
    "select l_suppkey, round(sum(l_extendedprice) / sum(l_quantity), 6) as ratio from lineitem group by 1",
)
def ratio_of_sums(t):
    return A.ratio_of_sums(t.lineitem, ["l_suppkey"], "l_extendedprice", "l_quantity").withColumn("ratio", F.round("ratio", 6))


@query(
    "mean_of_ratios",
    """
    select l_orderkey, round(avg(case when l_tax <> 0 then l_discount / l_tax when l_discount > 0 then 'inf'::double end), 9) as mean_ratio
    from lineitem group by 1
    """,
)
def mean_of_ratios(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.round(A.mean_of_ratios("l_discount", "l_tax"), 9).alias("mean_ratio"))


@query(
    "max_minus_const",
    """
    with y as (select year(o_orderdate) as year, avg(o_totalprice) as usual from orders group by 1)
    select year(o_orderdate) as year, round(max(o_totalprice) - min(usual), 4) as above
    from orders join y on year(o_orderdate) = y.year group by 1
    """,
)
def max_minus_const(t):
    from ..operators.joins import join, small

    usual = _year(t).groupBy("year").agg(F.avg("o_totalprice").alias("usual"))
    rows = join(_year(t), small(usual), ["year"], few=True)
    return A.max_minus_constant(rows, ["year"], "o_totalprice", "usual", "above").withColumn("above", F.round("above", 4))


@query(
    "collect_set",
    """
    select o_custkey, array_to_string(list_sort(list(distinct o_orderstatus)), '|') as statuses from orders group by 1
    """,
)
def collect_set(t):
    sets = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("s"))
    return sets.select("o_custkey", F.array_join("s", "|").alias("statuses"))


@query("distinct_rows", "select distinct o_custkey, o_orderstatus from orders")
def distinct_rows(t):
    return t.orders.select("o_custkey", "o_orderstatus").distinct()


@query(
    "distinct_keep_all",
    """
    select o_custkey, o_orderkey, o_totalprice, o_orderstatus from
      (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn = 1
    """,
)
def distinct_keep_all(t):
    first = R.first_per_key(t.orders, ["o_custkey"], M.desc("o_totalprice"), F.asc("o_orderkey"))
    return first.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")


STATUSES = {"F": "finished", "O": "open", "P": "pending"}


@query(
    "pivot_wider",
    """
    select year(o_orderdate) as year, count(case when o_orderstatus = 'F' then 1 end) as finished,
           count(case when o_orderstatus = 'O' then 1 end) as open, count(case when o_orderstatus = 'P' then 1 end) as pending
    from orders group by 1
    """,
)
def pivot_wider(t):
    wide = S.pivot_wider(_year(t), ["year"], "o_orderstatus", STATUSES, F.count(F.lit(1)))
    return wide.fillna(0)


@query(
    "pivot_longer",
    """
    with y as (select year(o_orderdate) as year, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1)
    select year, 'n' as metric, cast(n as double) as value from y union all select year, 'total', total from y
    """,
)
def pivot_longer(t):
    yearly = _year(t).groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return S.pivot_longer(yearly, ["year"], ["n", "total"], "metric", "value")


@query(
    "growth_rate",
    """
    with s as (select sum(o_totalprice) filter (where year(o_orderdate) = 1996) as a,
                      sum(o_totalprice) filter (where year(o_orderdate) = 2000) as b from orders)
    select round(a, 2) as old_total, round(b, 2) as new_total, round((b - a) / a, 8) as growth_rate from s
    """,
)
def growth_rate(t):
    grown = A.growth(_year(t), "year", F.col("o_totalprice"), 1996, 2000)
    return grown.select(
        F.round("old_total", 2).alias("old_total"), F.round("new_total", 2).alias("new_total"), F.round("growth_rate", 8).alias("growth_rate")
    )


@query(
    "group_ratio",
    """
    with g as (select c_nationkey, avg(c_acctbal) as balance from customer group by 1)
    select c_nationkey, round(balance, 4) as balance, round((select balance from g where c_nationkey = 3) /
           (select balance from g where c_nationkey = 7), 6) as ratio from g
    """,
)
def group_ratio(t):
    means = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("balance"))
    rows = A.against_group(means, "c_nationkey", "balance", 3, 7)
    return rows.select("c_nationkey", F.round("balance", 4).alias("balance"), F.round("ratio", 6).alias("ratio"))


@query(
    "quota_per_class",
    """
    with r as (select p_partkey, p_type, p_retailprice, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rn from part)
    select p_partkey, p_type, p_retailprice from r where (p_type = 'PROMO' and rn <= 4) or (p_type = 'LARGE' and rn <= 6)
    """,
)
def quota_per_class(t):
    rows = t.part.select("p_partkey", "p_type", "p_retailprice")
    return A.quota_per_class(rows, "p_type", {"PROMO": 4, "LARGE": 6}, [M.desc("p_retailprice"), F.asc("p_partkey")])


@query(
    "histogram_width",
    """
    select cast(ceil((o_totalprice - 12500) / 25000) as bigint) as bin, count(*) as n from orders
    where o_totalprice >= 0 and o_totalprice <= 400000 group by 1
    """,
)
def histogram_width(t):
    return A.histogram_width(t.orders, "o_totalprice", 25000, 0, 400000)


@query(
    "histogram_bins",
    """
    with s as (select min(o_totalprice) as lo, (max(o_totalprice) - min(o_totalprice)) / 29 as w from orders)
    select cast(ceil(round((o_totalprice - lo) / w, 9) - 0.5) as bigint) as bin, count(*) as n from orders, s group by 1
    """,
)
def histogram_bins(t):
    return A.histogram_bins(t.orders, "o_totalprice", 30)


@query(
    "histogram_2d",
    """
    with s as (select min(l_quantity) as ql, max(l_quantity) as qh, min(l_extendedprice) as pl, max(l_extendedprice) as ph from lineitem)
    select l_returnflag, cast(greatest(ceil(round((l_quantity - ql) / (qh - ql) * 30, 9)), 1) as bigint) as x_bin,
           cast(greatest(ceil(round((l_extendedprice - pl) / (ph - pl) * 20, 9)), 1) as bigint) as y_bin, count(*) as n
    from lineitem, s group by 1, 2, 3
    """,
)
def histogram_2d(t):
    return A.histogram_2d(t.lineitem, "l_returnflag", "l_quantity", "l_extendedprice", (30, 20))


@query(
    "five_number",
    """
    with q as (select o_orderpriority as g, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as q2,
                      quantile_cont(o_totalprice, 0.75) as q3 from orders group by 1),
         x as (select *, o_totalprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from orders join q on o_orderpriority = g)
    select g as o_orderpriority, min(case when inside then o_totalprice end) as whisker_low, round(min(q1), 4) as q1, round(min(q2), 4) as median,
           round(min(q3), 4) as q3, max(case when inside then o_totalprice end) as whisker_high, count(case when not inside then 1 end) as outliers
    from x group by 1
    """,
)
def five_number(t):
    rows = A.five_numbers(t.orders, ["o_orderpriority"], "o_totalprice")
    for c in ("q1", "median", "q3"):
        rows = rows.withColumn(c, F.round(c, 4))
    return rows


@query(
    "bucket_counts",
    """
    select case when c_acctbal >= -1000 and c_acctbal <= 2500 then 'Low' when c_acctbal > 2500 and c_acctbal <= 7500 then 'Medium'
                when c_acctbal > 7500 and c_acctbal <= 9000 then 'High' end as bucket, count(*) as n
    from customer group by 1
    """,
)
def bucket_counts(t):
    bucket = cut_right("c_acctbal", [-1000, 2500, 7500, 9000], ["Low", "Medium", "High"])
    return t.customer.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "group_profile",
    """
    select c_mktsegment, round(avg(c_acctbal), 3) as mean_balance, round(max(c_acctbal), 3) as max_balance, count(*) as n
    from customer group by 1 order by mean_balance desc, 1
    """,
)
def group_profile(t):
    profile = t.customer.groupBy("c_mktsegment").agg(
        F.round(F.avg("c_acctbal"), 3).alias("mean_balance"), F.round(F.max("c_acctbal"), 3).alias("max_balance"), F.count("*").alias("n")
    )
    return profile.orderBy(M.desc("mean_balance"), "c_mktsegment")


@query(
    "union_by_name",
    """
    select c_custkey as key, c_name as name, c_mktsegment as segment from customer
    union all select s_suppkey, s_name, null from supplier
    """,
)
def union_by_name(t):
    buyers = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return S.stack(buyers, t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("key")))


@query(
    "set_difference",
    "select c_custkey as custkey from customer except select o_custkey from orders where o_totalprice > 300000",
)
def set_difference(t):
    big = t.orders.where(F.col("o_totalprice") > 300000).select("o_custkey")
    return S.set_difference(t.customer.select(F.col("c_custkey").alias("custkey")), big)


@query("unique_values", "select distinct o_orderpriority from orders")
def unique_values(t):
    return t.orders.select("o_orderpriority").distinct()


@query(
    "union_distinct",
    "select c_nationkey as nationkey, c_acctbal > 5000 as rich from customer union select s_nationkey, s_acctbal > 5000 from supplier",
)
def union_distinct(t):
    buyers = t.customer.select(F.col("c_nationkey").alias("nationkey"), (F.col("c_acctbal") > 5000).alias("rich"))
    sellers = t.supplier.select(F.col("s_nationkey").alias("nationkey"), (F.col("s_acctbal") > 5000).alias("rich"))
    return S.stack(buyers, sellers).distinct()
