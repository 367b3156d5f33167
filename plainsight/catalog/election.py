"""Election study."""

from pyspark.sql import functions as F

from ..plans import bindings as B
from ..plans import election as E
from .registry import query

MOVES = {"NATION_3": (0.35, 40.0, -15.0), "NATION_7": (0.35, 55.0, -15.0)}

_VOTES = """
    with v as (
      select n_name as state, c_mktsegment as county, n_nationkey, n_regionkey, year(o_orderdate) as y, o_orderstatus as s
      from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
    m as (
      select state, county, n_nationkey, n_regionkey,
             cast(count(*) filter (y = 2000 and s = 'F') as double) as rep24, cast(count(*) filter (y = 2000 and s = 'O') as double) as dem24,
             cast(count(*) filter (y = 2000) as double) as tot24, cast(count(*) filter (y = 1996 and s = 'F') as double) as rep20,
             cast(count(*) filter (y = 1996 and s = 'O') as double) as dem20, cast(count(*) filter (y = 1996) as double) as tot20,
             (n_nationkey + 1) * 1e6::double + length(county) as area
      from v group by all having count(*) filter (y = 2000) > 0 and count(*) filter (y = 1996) > 0)
    """


def _merged(t):
    new = E.results(B.result_pages(t, 2000, "Kamala Harris Democratic"), E.COLUMNS_2024)
    old = E.results(B.result_pages(t, 1996, "Joe Biden Democratic"), E.COLUMNS_2020)
    return E.merge(new, old, B.counties(t))


@query(
    "el_results",
    _VOTES
    + """
    select county, state, format('{:,.0f}', rep24) as republican, format('{:,.0f}', dem24) as democratic, format('{:,.0f}', tot24 - rep24 - dem24) as other,
           format('{:,.0f}', rep24 - dem24) as margin, format('{:,.0f}', tot24) as total
    from (select state, county, cast(count(*) filter (s = 'F') as double) as rep24, cast(count(*) filter (s = 'O') as double) as dem24,
                 cast(count(*) as double) as tot24 from v where y = 2000 group by all)
    """,
)
def el_results(t):
    return E.results(B.result_pages(t, 2000, "Kamala Harris Democratic"), E.COLUMNS_2024)


@query(
    "el_merge",
    _VOTES
    + """
    select county, state, format('{:,.0f}', rep24) as republican_2024, format('{:,.0f}', rep24 - dem24) as margin_2024, format('{:,.0f}', tot24) as total_2024,
           format('{:,.0f}', rep20) as republican_2020, format('{:,.0f}', dem20) as democratic_2020, format('{:,.0f}', tot20) as total_2020, area as area_land
    from m
    """,
)
def el_merge(t):
    rows = _merged(t).withColumn("area_land", F.col("area_land").cast("double"))
    return rows.select(
        "county", "state", "republican_2024", "margin_2024", "total_2024", "republican_2020", "democratic_2020", "total_2020", "area_land"
    )


@query("el_top_votes", _VOTES + "select county, state, rep24 as votes from m order by 3 desc, 1, 2 limit 10")
def el_top_votes(t):
    return E.top_votes(_merged(t))


@query(
    "el_top_share",
    _VOTES + "select county, state, dem20 as votes, tot20 as total, round(dem20 / tot20, 3) as share from m order by 5 desc, 1, 2 limit 10",
)
def el_top_share(t):
    return E.top_share(_merged(t))


@query("el_shift", _VOTES + "select county, state, rep24 - rep20 as shift from m order by 3 desc, 1, 2 limit 10")
def el_shift(t):
    return E.top_shift(_merged(t))


@query(
    "el_state_shift",
    _VOTES
    + """
    select state, sum(rep24) as votes_2024, sum(rep20) as votes_2020, sum(rep24) - sum(rep20) as shift from m group by 1 order by 4 desc, 1 limit 10
    """,
)
def el_state_shift(t):
    return E.state_shift(_merged(t))


@query(
    "el_largest_area",
    _VOTES + "select county, state, area as area_land, round(area / 2.59e6, 2) as square_miles from m order by area desc, 1, 2 limit 1",
)
def el_largest_area(t):
    return E.largest_area(_merged(t))


@query(
    "el_density",
    _VOTES
    + """
    select county, state, tot20 as votes, round(area / 2.59e6, 6) as square_miles, round(tot20 / (area / 2.59e6), 6) as density
    from m order by tot20 / (area / 2.59e6) desc, 1, 2 limit 1
    """,
)
def el_density(t):
    rows = E.densest(_merged(t))
    return rows.withColumns({c: F.round(c, 6) for c in ("square_miles", "density")})


@query("el_turnout", _VOTES + "select county, state, tot24 - tot20 as increase from m order by 3 desc, 1, 2 limit 1")
def el_turnout(t):
    return E.turnout(_merged(t))


@query(
    "el_shift_map",
    _VOTES
    + """
    , c as (select county, state, rep24 / tot24 - rep20 / tot20 as shift, n_regionkey + (n_nationkey + 1) / 2 as x, n_nationkey + (n_nationkey + 1) / 2 as y,
                   case state when 'NATION_3' then 0.35 when 'NATION_7' then 0.35 else 1 end as k,
                   case state when 'NATION_3' then 40 when 'NATION_7' then 55 else 0 end as dx,
                   case state when 'NATION_3' then -15 when 'NATION_7' then -15 else 0 end as dy from m)
    select county, state, round(shift, 8) as shift, round(x * k + dx, 6) as lon, round(y * k + dy, 6) as lat,
           round(x * k + dx + shift * 5, 6) as xend, round(y * k + dy, 6) as yend from c
    """,
)
def el_shift_map(t):
    rows = E.shift_map(_merged(t), MOVES)
    return rows.withColumn("shift", F.round("shift", 8)).withColumns({c: F.round(c, 6) for c in ("lon", "lat", "xend", "yend")})
