"""Scalar functions: text, numbers, conditions, dates."""

from pyspark.sql import functions as F

from ..functions import conditions as C
from ..functions import missing as M
from ..functions import numbers as N
from ..functions import text
from ..functions.similarity import jaro
from ..operators import ranking as R
from .registry import query

_TITLE = r"array_to_string(list_transform(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}'']+|[^\p{{L}}\p{{N}}'']+'), lambda w: upper(w[1]) || w[2:]), '')"


@query(
    "title_case",
    f"""
    select p_partkey, {_TITLE.format("p_name || '-' || p_type")} as title, {_TITLE.format("p_brand || '''s ' || p_name")} as owned from part
    """,
)
def title_case(t):
    return t.part.select(
        "p_partkey",
        text.title_case(F.concat_ws("-", "p_name", "p_type")).alias("title"),
        text.title_case(F.concat("p_brand", F.lit("'s "), "p_name")).alias("owned"),
    )


@query("lower_trim", "select c_custkey, lower(c_mktsegment) as segment from customer")
def lower_trim(t):
    padded = F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.lit("\n "))
    return t.customer.select("c_custkey", text.lower_trim(padded).alias("segment"))


@query(
    "replace_all",
    "select p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') as masked, replace(p_name, ' ', '') as tight from part",
)
def replace_all(t):
    masked = F.regexp_replace("p_name", "[aeiou]", "*")
    return t.part.select("p_partkey", masked.alias("masked"), text.squash_blanks("p_name").alias("tight"))


@query("percent_to_ratio", "select l_orderkey, l_partkey, cast(round(l_discount * 100) as double) / 100 as ratio from lineitem")
def percent_to_ratio(t):
    shown = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    return t.lineitem.select("l_orderkey", "l_partkey", text.percent_to_ratio(shown).alias("ratio"))


@query("strip_to_number", "select c_custkey, abs(c_acctbal) as balance from customer")
def strip_to_number(t):
    return t.customer.select("c_custkey", text.strip_to_number(text.dollars("c_acctbal")).alias("balance"))


@query("comma_number", "select l_orderkey, l_partkey, l_extendedprice from lineitem")
def comma_number(t):
    return t.lineitem.select("l_orderkey", "l_partkey", text.comma_number(text.grouped("l_extendedprice", 2)).alias("l_extendedprice"))


@query(
    "parse_number",
    "select c_custkey, -abs(c_acctbal) as shown, cast(null as double) as none from customer",
)
def parse_number(t):
    shown = F.concat(F.lit("about -"), F.format_number("c_acctbal", 2), F.lit(" (was 17)"))
    return t.customer.select(
        "c_custkey", text.parse_number(shown).alias("shown"), text.parse_number("c_mktsegment").alias("none")
    )


@query(
    "dash_to_zero",
    "select c_custkey, case when c_acctbal < 2000 then 0 else c_acctbal end as fuel from customer",
)
def dash_to_zero(t):
    written = F.when(F.col("c_acctbal") < 1000, F.lit("-")).when(F.col("c_acctbal") >= 2000, F.col("c_acctbal").cast("string"))
    return t.customer.select("c_custkey", text.dash_to_zero(written).alias("fuel"))


@query(
    "regex_capture",
    r"""
    select c_custkey, nullif(regexp_extract(c_name, '#(\d+)', 1), '') as number, c_mktsegment as last_part from customer
    """,
)
def regex_capture(t):
    uri = F.concat_ws(":", F.lit("catalog"), F.col("c_name"), F.col("c_mktsegment"))
    return t.customer.select(
        "c_custkey", text.capture("c_name", r"#(\d+)").alias("number"), text.last_uri_part(uri).alias("last_part")
    )


@query(
    "build_key",
    "select o_orderkey, 'slice.' || lpad(cast(o_custkey % 10000 as varchar), 4, '0') || '-' || o_orderstatus as key from orders",
)
def build_key(t):
    key = F.format_string("slice.%04d-%s", F.col("o_custkey") % 10000, F.col("o_orderstatus"))
    return t.orders.select("o_orderkey", key.alias("key"))


@query(
    "slugify",
    "select p_partkey, case when p_name = 'red ring' then 'red_ring_(part)' else replace(p_name, ' ', '_') end as slug from part",
)
def slugify(t):
    return t.part.select("p_partkey", text.slug("p_name", {"red ring": "red_ring_(part)"}).alias("slug"))


@query("regex_any_ci", "select p_partkey, p_type from part where regexp_matches(p_type, '(?i)promo|standard|eco')")
def regex_any_ci(t):
    return t.part.where(text.any_of("p_type", ["promo", "Standard", "eco"])).select("p_partkey", "p_type")


@query(
    "jaro_score",
    "select p_partkey, round(jaro_similarity(p_name, lower(p_type)), 6) as score from part",
)
def jaro_score(t):
    return t.part.select("p_partkey", F.round(jaro(F.col("p_name"), F.lower("p_type")), 6).alias("score"))


@query(
    "weighted_row_sum",
    """
    select l_orderkey, l_partkey, round(l_quantity * 22.45 + l_tax * 18.32 + l_discount * 0.0, 4) as total from lineitem
    """,
)
def weighted_row_sum(t):
    total = N.weighted_sum({"l_quantity": 22.45, "l_tax": 18.32, "l_discount": 0})
    return t.lineitem.select("l_orderkey", "l_partkey", F.round(total, 4).alias("total"))


@query(
    "safe_ratio",
    """
    with x as (select l_orderkey, l_partkey, l_tax, l_discount, case when l_discount <> 0 then round(l_tax / l_discount, 6)
      when l_tax = 0 then null else 999999 end as r from lineitem)
    select l_orderkey, l_partkey, r as ratio, l_discount = 0 and l_tax = 0 as undefined from x
    """,
)
def safe_ratio(t):
    r = M.ratio("l_tax", "l_discount")
    shown = F.when(F.isnan(r), F.lit(None)).when(r == float("inf"), 999999.0).otherwise(F.round(r, 6))
    return t.lineitem.select("l_orderkey", "l_partkey", shown.alias("ratio"), F.isnan(r).alias("undefined"))


@query("round_half_even", "select l_orderkey, l_partkey, cast(round_even(l_quantity / 2, 0) as double) as half from lineitem")
def round_half_even(t):
    return t.lineitem.select("l_orderkey", "l_partkey", N.round_even(F.col("l_quantity") / 2).alias("half"))


@query(
    "decade",
    """
    select cast(floor(year(o_orderdate) / 5) * 5 as bigint) as band, cast(floor(year(o_orderdate) / 10) * 10 as bigint) as decade,
           cast(floor((o_custkey - 700) / 100.0) * 100 as bigint) as signed, count(*) as n
    from orders group by 1, 2, 3
    """,
)
def decade(t):
    year = F.year("o_orderdate")
    keys = [N.band(year, 5).alias("band"), N.decade(year).alias("decade"), N.band(F.col("o_custkey") - 700, 100).alias("signed")]
    return t.orders.groupBy(*keys).agg(F.count("*").alias("n"))


@query(
    "unit_convert",
    """
    select p_partkey, round(p_retailprice / 60000, 8) as minutes, round(p_size * 1e6 / 2590000, 6) as miles, p_retailprice * 10 as per_mwh from part
    """,
)
def unit_convert(t):
    return t.part.select(
        "p_partkey",
        F.round(N.ms_to_minutes("p_retailprice"), 8).alias("minutes"),
        F.round(N.square_miles(F.col("p_size") * 1e6), 6).alias("miles"),
        (F.col("p_retailprice") * N.CENTS_PER_KWH_TO_DOLLARS_PER_MWH).alias("per_mwh"),
    )


@query(
    "share_shift",
    """
    with v as (select c_nationkey, count(*) filter (where y = 2000 and s = 'F') as n1, count(*) filter (where y = 2000) as d1,
                      count(*) filter (where y = 1996 and s = 'F') as n0, count(*) filter (where y = 1996) as d0
      from (select c_nationkey, year(o_orderdate) as y, o_orderstatus as s from orders join customer on o_custkey = c_custkey) group by 1)
    select c_nationkey, round(case when d1 > 0 and d0 > 0 then n1 / d1 - n0 / d0 end, 8) as shift from v
    """,
)
def share_shift(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    year, done = F.year("o_orderdate"), F.col("o_orderstatus") == "F"
    votes = rows.groupBy("c_nationkey").agg(
        F.count_if((year == 2000) & done).alias("n1"),
        F.count_if(year == 2000).alias("d1"),
        F.count_if((year == 1996) & done).alias("n0"),
        F.count_if(year == 1996).alias("d0"),
    )
    shift = M.nan_to_null(N.share_shift("n1", "d1", "n0", "d0"))
    return votes.select("c_nationkey", F.round(shift, 8).alias("shift"))


@query(
    "case_when",
    """
    select c_custkey, case when c_mktsegment = 'BUILDING' then c_acctbal when c_acctbal < 100 then c_acctbal * 40
      when c_acctbal >= 5000 then c_acctbal / 260 end as pay from customer
    """,
)
def case_when(t):
    balance = F.col("c_acctbal")
    pay = (
        F.when(F.col("c_mktsegment") == "BUILDING", balance)
        .when(balance < 100, balance * 40)
        .when(balance >= 5000, balance / 260)
        .otherwise(F.lit(None).cast("double"))
    )
    return t.customer.select("c_custkey", pay.alias("pay"))


@query(
    "threshold_bucket",
    """
    select o_orderkey, case when o_orderstatus = 'P' then 'Unknown' when o_totalprice < 100000 then 'Small'
      when o_totalprice >= 100000 and o_totalprice <= 300000 then 'Medium' else 'Large' end as size from orders
    """,
)
def threshold_bucket(t):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.select("o_orderkey", C.low_mid_high(known, 100000, 300000).alias("size"))


@query(
    "cut_right_closed",
    """
    select c_custkey, case when b >= 0 and b <= 25 then 'Low' when b > 25 and b <= 75 then 'Medium' when b > 75 and b <= 90 then 'High' end as grp
    from (select c_custkey, floor(c_acctbal / 100) as b from customer)
    """,
)
def cut_right_closed(t):
    return t.customer.select(
        "c_custkey", C.cut_right(F.floor(F.col("c_acctbal") / 100), [0, 25, 75, 90], ["Low", "Medium", "High"]).alias("grp")
    )


@query(
    "recode_map",
    """
    select l_returnflag, l_linestatus, case l_returnflag when 'A' then 'Accepted' when 'R' then 'Returned' else 'Unknown' end as label,
           count(*) as n from lineitem group by 1, 2, 3
    """,
)
def recode_map(t):
    label = C.recode("l_returnflag", {"A": "Accepted", "R": "Returned"}, "Unknown")
    return t.lineitem.groupBy("l_returnflag", "l_linestatus", label.alias("label")).agg(F.count("*").alias("n"))


@query(
    "if_else",
    """
    select o_orderkey, case when o_orderstatus = 'P' then null when o_totalprice >= 200000 then 'Popular' else 'Not Popular' end as label from orders
    """,
)
def if_else(t):
    known = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return t.orders.select("o_orderkey", C.if_else(known >= 200000, "Popular", "Not Popular").alias("label"))


@query(
    "cast_safe",
    """
    select event_id, try_cast(case when event_type = 'view' then event_type else json_extract_string(props, '$.k') end as double) as k,
           case event_type when 'view' then 1 when 'click' then 2 when 'purchase' then 3 end as stage
    from events
    """,
)
def cast_safe(t):
    written = F.when(F.col("event_type") == "view", F.col("event_type")).otherwise(F.get_json_object("props", "$.k"))
    stage = C.rank_of("event_type", ["view", "click", "purchase"])
    return t.events.select("event_id", written.try_cast("double").alias("k"), stage.cast("int").alias("stage"))


@query(
    "factor_codes",
    """
    select o_orderkey, o_orderpriority, dense_rank() over (order by o_orderpriority) as code,
           cast(case o_orderpriority when '5-LOW' then 1 when '1-URGENT' then 2 end as bigint) as given
    from orders
    """,
)
def factor_codes(t):
    rows = R.factor_codes(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderpriority", "code")
    return R.factor_codes(rows, "o_orderpriority", "given", ["5-LOW", "1-URGENT"])


@query(
    "tiered_pay",
    """
    select l_orderkey, l_partkey, round(case when l_linestatus = 'O' then b when b < 100 then b * (l_quantity + l_tax * 1.5)
      when b >= 100 then (b / 260) * (l_quantity / 7.5) end, 8) as pay
    from (select *, l_extendedprice / 100 as b from lineitem)
    """,
)
def tiered_pay(t):
    pay = N.tiered_pay(F.col("l_extendedprice") / 100, "l_quantity", "l_tax", F.col("l_linestatus") == "O")
    return t.lineitem.select("l_orderkey", "l_partkey", F.round(pay, 8).alias("pay"))


@query("by_year", "select year(l_shipdate) as year, sum(l_quantity) as qty, count(*) as n from lineitem group by 1")
def by_year(t):
    return t.lineitem.groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
