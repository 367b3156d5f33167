"""Transit: electricity profiles, agency energy and service, emissions per trip and mile.

Tables: electricity profile ``state, abbreviation, co2_mwh, primary_source,
price_mwh, generation_mwh``; energy ``ntd_id, agency, mode`` and 13 fuels;
service ``ntd_id, agency, city, state, upt, miles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import missing as M
from ..functions import text
from ..functions.conditions import low_mid_high, recode
from ..functions.numbers import CENTS_PER_KWH_TO_DOLLARS_PER_MWH, row_sum, weighted_sum
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import projection as P
from ..operators import ranking as R
from ..sources import html
from ..sources.dimensions import ELECTRIC_FUELS, EMISSION_FACTORS, FUELS, TRANSIT_MODES

# Published column names and their names here.
ENERGY_NAMES = {"NTD ID": "ntd_id", "Agency Name": "agency", "Mode": "mode", "TOS": "tos"}
ENERGY_UNUSED = ["reporter_type", "reporting_module", "other_fuel", "other_fuel_description"]
SERVICE_NAMES = {
    "agency": "Agency",
    "max_city": "City",
    "max_state": "State",
    "sum_unlinked_passenger_trips_upt": "UPT",
    "sum_passenger_miles": "MILES",
}
PER_TRIP = (2.0, 4.0)
PER_MILE = (0.1, 0.3)
AGENCY_SIZE = (500_000, 20_000_000)


# -- electricity profiles ---------------------------------------------------


def profiles(pages: DataFrame) -> DataFrame:
    """``(state, abbreviation, page)`` rows to one profile per state, from each page's first table."""
    found = pages.select("state", "abbreviation", html.first_table(html.html_tables("page")).alias("tbl"))
    rows = html.table_rows(found, "tbl", {"Item": "item", "Value": "value", "Rank": "rank", "U.S. rank": "us_rank"})
    cells = rows.withColumn("item", F.lower("item")).withColumn("rank", F.coalesce("rank", "us_rank"))
    value = F.col("value")
    return P.record_of(
        cells,
        ["state", "abbreviation"],
        "item",
        {
            "co2_mwh": ("carbon dioxide (lbs/mwh)", text.comma_number(value)),
            "primary_source": ("primary energy source", F.col("rank")),
            "price_mwh": (
                "average retail price (cents/kwh)",
                value.try_cast("double") * CENTS_PER_KWH_TO_DOLLARS_PER_MWH,
            ),
            "generation_mwh": ("net generation (megawatthours)", text.comma_number(value)),
        },
    )


def report(sep: DataFrame) -> DataFrame:
    """Profiles in display form, dirtiest first."""
    shown = sep.orderBy(M.desc("co2_mwh"), "state").select(
        "state",
        text.grouped("co2_mwh").alias("co2_mwh"),
        "primary_source",
        text.dollars("price_mwh").alias("price_mwh"),
        text.grouped("generation_mwh").alias("generation_mwh"),
    )
    return shown


def _top_number(shown: DataFrame, col: str) -> DataFrame:
    known = shown.where(F.col(col).isNotNull()).select("state", text.strip_to_number(col).alias(col))
    return R.top_n(known, 1, M.desc(col), F.asc("state"))


def top_price(shown: DataFrame) -> DataFrame:
    return _top_number(shown, "price_mwh").withColumn("price_mwh", text.dollars("price_mwh"))


def dirtiest(shown: DataFrame) -> DataFrame:
    return _top_number(shown, "co2_mwh").withColumn("co2_mwh", text.grouped("co2_mwh"))


def weighted_co2(shown: DataFrame) -> DataFrame:
    known = shown.where(F.col("co2_mwh").isNotNull())
    mean = A.weighted_mean(text.strip_to_number("co2_mwh"), text.strip_to_number("generation_mwh"))
    return known.agg(text.grouped(mean).alias("weighted_co2"))


def rarest_source(shown: DataFrame) -> DataFrame:
    """The least used source, its mean price and the state that names it most.

    The mean is rounded before display, which then does not hang on the order of the sum.
    """
    mean = F.round(F.avg(text.strip_to_number("price_mwh")), 6)
    stats = shown.groupBy("primary_source").agg(F.count("*").alias("n"), mean.alias("price_mwh"))
    first = R.top_n(stats, 1, F.asc("n"), F.asc("primary_source"))
    states = A.group_mode(shown, ["primary_source"], "state", "state").drop("n")
    rows = J.join(first, states, ["primary_source"], few=True)
    return rows.select("primary_source", text.dollars("price_mwh").alias("price_mwh"), "state")


def compare(shown: DataFrame, clean: str, dirty: str) -> DataFrame:
    two = shown.where(F.col("state").isin(clean, dirty))
    means = two.groupBy("state").agg(F.avg(text.strip_to_number("co2_mwh")).alias("co2_mwh"))
    rows = A.against_group(means, "state", "co2_mwh", clean, dirty)
    return rows.withColumn("ratio", F.round("ratio", 2)).orderBy("state")


# -- energy and service -----------------------------------------------------


def energy(raw: DataFrame) -> DataFrame:
    """Fuel use per agency and mode; rows without any fuel are dropped."""
    keep = raw.drop(*ENERGY_UNUSED)
    numbers = P.map_columns(keep, text.dash_to_zero, but=["agency", "mode", "tos"])
    groups = ["ntd_id", "mode", "agency"]
    sums = A.sum_all_numeric(numbers, groups)
    return sums.where(row_sum(P.numeric_columns(sums, but=groups)) > 0)


def read_energy(raw: DataFrame) -> DataFrame:
    """The published energy sheet, landed as text, under the names used here."""
    return P.clean_names(raw.withColumnsRenamed(ENERGY_NAMES))


def name_modes(rows: DataFrame) -> DataFrame:
    return rows.withColumn("mode", recode("mode", TRANSIT_MODES, "Unknown"))


def modes(rows: DataFrame) -> DataFrame:
    """Mode codes in use, with their names."""
    return rows.select("mode").distinct().withColumn("name", recode("mode", TRANSIT_MODES, "Unknown"))


def service(raw: DataFrame) -> DataFrame:
    """Published columns are renamed in capitals, all others dropped by that pattern."""
    numbered = raw.withColumn("NTD_ID", F.col("_5_digit_ntd_id").try_cast("double"))
    named = numbered.withColumnsRenamed(SERVICE_NAMES)
    kept = P.select_matching(named, "^[A-Z]").where(F.col("MILES") > 0)
    return kept.toDF(*[c.lower() for c in kept.columns])


def most_trips(svc: DataFrame) -> DataFrame:
    sums = svc.groupBy("agency", "city", "state").agg(M.sum0("upt").alias("total_upt"))
    top = R.top_n(sums, 1, M.desc("total_upt"), F.asc("agency"))
    return top.withColumn("total_upt", text.grouped("total_upt"))


def trip_length(svc: DataFrame, agency: str, grouped: bool = True) -> DataFrame:
    rows = svc.where(F.col("agency") == agency)
    return rows.groupBy(*(["agency"] if grouped else [])).agg(F.avg("miles").alias("mean_miles"))


def longest_trip(svc: DataFrame, cities: Sequence[str]) -> DataFrame:
    rows = svc.where(F.col("city").isin(list(cities)))
    return rows.groupBy("agency").agg(F.avg("miles").alias("mean_miles")).orderBy(M.desc("mean_miles"), "agency")


def fewest_miles(svc: DataFrame) -> DataFrame:
    sums = svc.groupBy("state").agg(M.sum0("miles").alias("total_miles"))
    return R.top_n(sums, 1, M.asc("total_miles"), F.asc("state"))


def missing_states(svc: DataFrame, states: DataFrame) -> DataFrame:
    """States without service. ``states`` holds ``state, abbreviation, position``."""
    absent = states.select("abbreviation").subtract(svc.select("state"))
    return J.lookup_first(absent, states, {"abbreviation": "abbreviation"}, "state", "position")


# -- emissions --------------------------------------------------------------


def merge(svc: DataFrame, fuel: DataFrame, sep: DataFrame) -> DataFrame:
    """Service, left-joined to fuel use per mode and to the state's electricity."""
    fuel = fuel.drop("agency")
    power = sep.select(F.col("abbreviation").alias("state"), "co2_mwh")
    rows = J.join(J.join(svc, fuel, ["ntd_id"], few=True), power, ["state"], few=True)
    return rows.select("agency", "mode", "ntd_id", "city", "state", "upt", "miles", *FUELS, "co2_mwh")


def total_emissions(merged: DataFrame) -> DataFrame:
    return merged.withColumn("total_emissions", weighted_sum(EMISSION_FACTORS))


def per_trip(rows: DataFrame) -> DataFrame:
    rate = rows.withColumn("per_upt", M.ratio("total_emissions", "upt"))
    return rate.withColumn("category", low_mid_high("per_upt", *PER_TRIP))


def per_mile(rows: DataFrame) -> DataFrame:
    rate = rows.withColumn("per_mile", M.ratio("total_emissions", "miles"))
    return rate.withColumn("category", low_mid_high("per_mile", *PER_MILE))


def by_agency(rows: DataFrame, require_match: bool = False) -> DataFrame:
    """Totals and ratios per agency.

    Trips and miles repeat once per mode, as the join leaves them. An agency
    without fuel data totals 0; ``require_match`` leaves it out.
    """
    if require_match:
        rows = rows.where(F.col("total_emissions").isNotNull())
    sums = rows.groupBy("agency").agg(
        M.sum0("total_emissions").alias("total_emissions"),
        M.sum0("upt").alias("total_upt"),
        M.sum0("miles").alias("total_miles"),
    )
    return P.derive(
        sums,
        per_upt=M.ratio("total_emissions", "total_upt"),
        per_mile=M.ratio("total_emissions", "total_miles"),
        category_upt=low_mid_high("per_upt", *PER_TRIP),
        category_mile=low_mid_high("per_mile", *PER_MILE),
    )


def greenest(agencies: DataFrame) -> DataFrame:
    return R.top_n(agencies, 1, *M.asc_missing_last("per_upt"), F.asc("agency"))


def worst(agencies: DataFrame) -> DataFrame:
    return R.top_n(agencies, 1, M.desc("total_emissions"), F.asc("agency"))


def electrification(rows: DataFrame, n: int = 1) -> DataFrame:
    """Mean electric share of fuel per agency, highest first."""
    electric = F.col(ELECTRIC_FUELS[0]) + F.col(ELECTRIC_FUELS[1])
    share = A.mean_of_ratios(electric, row_sum(FUELS)) * 100
    means = rows.groupBy("agency").agg(share.alias("electric_percent"))
    return R.top_n(means, n, M.desc("electric_percent"), F.asc("agency"))


def sized(agencies: DataFrame, small: float = AGENCY_SIZE[0], large: float = AGENCY_SIZE[1]) -> DataFrame:
    trips = F.col("total_upt")
    size = F.when(trips < small, "Small").when(trips < large, "Medium").when(trips >= large, "Large").otherwise("Unknown")
    return agencies.withColumn("size", size)


def best_by_size(agencies: DataFrame) -> DataFrame:
    """The greenest agency of every size class, in one pass."""
    return R.top_per_group(agencies, ["size"], 1, *M.asc_missing_last("per_upt"), F.asc("agency"))
