"""Transit study."""

from pyspark.sql import functions as F

from ..operators.ranking import sample_n
from ..plans import bindings as B
from ..plans import transit as X
from ..sources.dimensions import FUELS
from .registry import query

_SEP = """
    with mode as (
      select c_nationkey, c_mktsegment as source from (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2)
      qualify row_number() over (partition by c_nationkey order by n desc, c_mktsegment) = 1),
    sep as (
      select n_name as state, 'N' || n_nationkey as abbreviation, round(avg(c_acctbal) / 5) as co2_mwh, min(source) as primary_source,
             round(round(avg(c_acctbal) / 400, 2) * 10, 2) as price_mwh, cast(count(*) * 1234567 as double) as generation_mwh
      from customer join nation on c_nationkey = n_nationkey join mode using (c_nationkey) group by n_name, n_nationkey)
    """

_USED = {v: k for k, v in B.FUEL_OF_TYPE.items()}
_FUEL_SUMS = ", ".join(
    f"coalesce(sum(l_quantity) filter (where p_type = '{_USED[f]}'), 0.0) / 256.0::double as {f}" if f in _USED else f"0.0::double as {f}" for f in FUELS
)
_ENERGY = f"""
    energy as (
      select cast(case when l_suppkey % 10 = 0 then 9000000000 + l_suppkey else l_suppkey end as double) as ntd_id,
             case case when l_suppkey % 7 = 0 and l_returnflag = 'N' then 'A' else l_returnflag end when 'A' then 'MB' when 'N' then 'DR' else 'ZZ' end as mode,
             'Agency ' || l_suppkey as agency, {_FUEL_SUMS}
      from lineitem join part on l_partkey = p_partkey group by l_suppkey, 2)
    """
_SERVICE = """
    service as (
      select s_name as agency, 'City ' || s_suppkey % 10 as city, 'N' || s_nationkey as state, cast(count(*) as double) as upt,
             sum(l_quantity) as miles, cast(s_suppkey as double) as ntd_id
      from supplier join lineitem on s_suppkey = l_suppkey group by s_suppkey, s_name, s_nationkey)
    """
_FACTORS = "bio_diesel * 22.45 + diesel_fuel * 22.45 + gasoline * 20.86 + liquified_nat_gas * 120.85"
_NAMED = "case mode when 'MB' then 'Motorbus' when 'DR' then 'Demand Response' else 'Unknown' end"
_MERGED = (
    _SEP
    + f""", {_ENERGY}, {_SERVICE}, merged as (
      select s.agency, case when e.mode is not null then {_NAMED.replace("mode", "e.mode")} end as mode, s.ntd_id, s.city, s.state, s.upt, s.miles,
             {", ".join("e." + f for f in FUELS)}, co2_mwh, {_FACTORS} as total_emissions
      from service s left join energy e on s.ntd_id = e.ntd_id left join sep p on s.state = p.abbreviation),
    agencies0 as (
      select agency, coalesce(sum(total_emissions), 0) as total_emissions, sum(upt) as total_upt, sum(miles) as total_miles from merged group by 1),
    agencies as (
      select *, total_emissions / total_upt as per_upt, total_emissions / total_miles as per_mile,
             case when total_emissions / total_upt < 2 then 'Small' when total_emissions / total_upt <= 4 then 'Medium' else 'Large' end as category_upt,
             case when total_emissions / total_miles < 0.1 then 'Small' when total_emissions / total_miles <= 0.3 then 'Medium' else 'Large' end as category_mile
      from agencies0),
    sized as (select *, case when total_upt < 700 then 'Small' when total_upt < 1300 then 'Medium' else 'Large' end as size from agencies)
    """
)
_AGENCY_COLS = """agency, round(total_emissions, 4) as total_emissions, total_upt, total_miles, round(per_upt, 10) as per_upt,
    round(per_mile, 10) as per_mile, category_upt, category_mile"""


def _sep(t):
    return X.profiles(B.profile_pages(t))


def _shown(t):
    return X.report(_sep(t))


def _energy(t):
    return X.energy(B.energy_raw(t))


def _service(t):
    return X.service(B.service_raw(t))


def _merged(t):
    return X.merge(_service(t), X.name_modes(_energy(t)), _sep(t))


def _emissions(t):
    return X.total_emissions(_merged(t))


def _agencies(t):
    return X.by_agency(_emissions(t))


def _rounded(df):
    digits = {"total_emissions": 4, "per_upt": 10, "per_mile": 10}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items() if c in df.columns})


@query(
    "sep_report",
    _SEP
    + """
    select state, format('{:,.0f}', co2_mwh) as co2_mwh, primary_source, '$' || format('{:,.2f}', price_mwh) as price_mwh,
           format('{:,.0f}', generation_mwh) as generation_mwh from sep
    """,
)
def sep_report(t):
    return _shown(t)


@query(
    "sep_top_price",
    _SEP + "select state, '$' || format('{:,.2f}', price_mwh) as price_mwh from sep order by sep.price_mwh desc, state limit 1",
)
def sep_top_price(t):
    return X.top_price(_shown(t))


@query(
    "sep_dirtiest",
    _SEP + "select state, format('{:,.0f}', co2_mwh) as co2_mwh from sep order by sep.co2_mwh desc, state limit 1",
)
def sep_dirtiest(t):
    return X.dirtiest(_shown(t))


@query(
    "sep_weighted",
    _SEP + "select format('{:,.0f}', sum(co2_mwh * generation_mwh) / sum(generation_mwh)) as weighted_co2 from sep",
)
def sep_weighted(t):
    return X.weighted_co2(_shown(t))


@query(
    "sep_rarest",
    _SEP
    + """
    select primary_source, '$' || format('{:,.2f}', round(avg(price_mwh), 6)) as price_mwh, min(state) as state
    from sep group by 1 order by count(*), 1 limit 1
    """,
)
def sep_rarest(t):
    return X.rarest_source(_shown(t))


@query(
    "sep_compare",
    _SEP
    + """
    select state, co2_mwh, round((select co2_mwh from sep where state = 'NATION_3') / (select co2_mwh from sep where state = 'NATION_7'), 2) as ratio
    from sep where state in ('NATION_3', 'NATION_7') order by 1
    """,
)
def sep_compare(t):
    return X.compare(_shown(t), "NATION_3", "NATION_7")


@query("ntd_energy_clean", "with " + _ENERGY + f"select ntd_id, mode, agency, {', '.join(FUELS)} from energy")
def ntd_energy_clean(t):
    return _energy(t)


@query(
    "ntd_energy_sample",
    "with " + _ENERGY + f"select ntd_id, mode, agency, {', '.join(FUELS)} from energy order by md5('42|' || cast(ntd_id as bigint) || '|' || mode) limit 10",
)
def ntd_energy_sample(t):
    return sample_n(_energy(t), 10, ["ntd_id", "mode"])


@query("ntd_modes", "with " + _ENERGY + f"select distinct mode, {_NAMED} as name from energy")
def ntd_modes(t):
    return X.modes(_energy(t))


@query("ntd_service_clean", "with " + _SERVICE + "select * from service where miles > 0")
def ntd_service_clean(t):
    return _service(t)


@query(
    "ntd_most_trips",
    "with " + _SERVICE + "select agency, city, state, format('{:,.0f}', upt) as total_upt from service order by upt desc, agency limit 1",
)
def ntd_most_trips(t):
    return X.most_trips(_service(t))


@query(
    "ntd_trip_length",
    "with " + _SERVICE + "select agency, round(avg(miles), 4) as mean_miles from service where agency = 'Supplier#000000003' group by 1",
)
def ntd_trip_length(t):
    return X.trip_length(_service(t), "Supplier#000000003").withColumn("mean_miles", F.round("mean_miles", 4))


@query(
    "ntd_longest_trip",
    "with " + _SERVICE + """select agency, round(avg(miles), 4) as mean_miles from service where city in ('City 1', 'City 4', 'City 7') group by 1""",
)
def ntd_longest_trip(t):
    return X.longest_trip(_service(t), ["City 1", "City 4", "City 7"]).withColumn("mean_miles", F.round("mean_miles", 4))


@query(
    "ntd_fewest_miles",
    "with " + _SERVICE + "select state, sum(miles) as total_miles from service group by 1 order by 2, 1 limit 1",
)
def ntd_fewest_miles(t):
    return X.fewest_miles(_service(t))


@query(
    "ntd_missing_states",
    "with "
    + _SERVICE
    + """, terr as (select n_name as state, 'N' || n_nationkey as abbreviation from nation union all select r_name, 'R' || r_regionkey from region)
    select abbreviation, state from terr where abbreviation not in (select state from service)
    """,
)
def ntd_missing_states(t):
    return X.missing_states(_service(t), B.territories(t))


@query(
    "emissions_merge",
    _MERGED + f"select agency, mode, ntd_id, city, state, upt, miles, {', '.join(FUELS)}, co2_mwh from merged",
)
def emissions_merge(t):
    return _merged(t)


@query("emissions_total", _MERGED + "select agency, mode, round(total_emissions, 4) as total_emissions from merged")
def emissions_total(t):
    return _rounded(_emissions(t).select("agency", "mode", "total_emissions"))


@query(
    "emissions_per_trip",
    _MERGED
    + """
    select agency, mode, round(total_emissions / upt, 10) as per_upt, case when total_emissions is null then 'Unknown'
      when total_emissions / upt < 2 then 'Small' when total_emissions / upt <= 4 then 'Medium' else 'Large' end as category from merged
    """,
)
def emissions_per_trip(t):
    return _rounded(X.per_trip(_emissions(t)).select("agency", "mode", "per_upt", "category"))


@query(
    "emissions_per_mile",
    _MERGED
    + """
    select agency, mode, round(total_emissions / miles, 10) as per_mile, case when total_emissions is null then 'Unknown'
      when total_emissions / miles < 0.1 then 'Small' when total_emissions / miles <= 0.3 then 'Medium' else 'Large' end as category from merged
    """,
)
def emissions_per_mile(t):
    return _rounded(X.per_mile(_emissions(t)).select("agency", "mode", "per_mile", "category"))


@query("agency_emissions", _MERGED + f"select {_AGENCY_COLS} from agencies")
def agency_emissions(t):
    return _rounded(_agencies(t))


@query("greenest", _MERGED + f"select {_AGENCY_COLS} from agencies order by agencies.per_upt, agency limit 1")
def greenest(t):
    return _rounded(X.greenest(_agencies(t)))


@query("worst_agency", _MERGED + f"select {_AGENCY_COLS} from agencies order by agencies.total_emissions desc, agency limit 1")
def worst_agency(t):
    return _rounded(X.worst(_agencies(t)))


@query(
    "electrification",
    _MERGED
    + f"""
    select agency, round(avg((electric_battery + electric_propulsion) / ({" + ".join(FUELS)})) * 100, 6) as electric_percent
    from merged group by 1 order by avg((electric_battery + electric_propulsion) / ({" + ".join(FUELS)})) desc nulls last, 1 limit 25
    """,
)
def electrification(t):
    return X.electrification(_emissions(t), 25).withColumn("electric_percent", F.round("electric_percent", 6))


@query("agency_size", _MERGED + "select size, count(*) as agencies from sized group by 1")
def agency_size(t):
    return X.sized(_agencies(t), 700, 1300).groupBy("size").agg(F.count("*").alias("agencies"))


def _best(t, size):
    rows = X.sized(_agencies(t), 700, 1300).where(F.col("size") == size)
    return _rounded(X.best_by_size(rows).select("size", "agency", "per_upt"))


_BEST = _MERGED + "select size, agency, round(per_upt, 10) as per_upt from sized where size = '{}' order by sized.per_upt, agency limit 1"


@query("best_by_size", _MERGED + """select size, agency, round(per_upt, 10) as per_upt from sized
    qualify row_number() over (partition by size order by sized.per_upt, agency) = 1""")
def best_by_size(t):
    return _rounded(X.best_by_size(X.sized(_agencies(t), 700, 1300)).select("size", "agency", "per_upt"))


@query("best_small", _BEST.format("Small"))
def best_small(t):
    return _best(t, "Small")


@query("best_medium", _BEST.format("Medium"))
def best_medium(t):
    return _best(t, "Medium")


@query("best_large", _BEST.format("Large"))
def best_large(t):
    return _best(t, "Large")
