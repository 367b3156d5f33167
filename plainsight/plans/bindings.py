"""The studies' input tables, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_case
from ..tables import Tables


def payroll(t: Tables) -> DataFrame:
    """Line items as payroll records: the segment is the agency, the priority the position.

    Names are put in title case in their own table, before the joins.
    """
    people = t.customer.withColumn("agency_name", title_case("c_mktsegment")).selectExpr(
        "c_custkey",
        "agency_name",
        "'Customer' AS first_name",
        "substring(c_mktsegment, 1, 1) AS mid_init",
        "c_name AS last_name",
        "concat('Nation_', c_nationkey) AS work_location",
    )
    jobs = t.orders.withColumn("position", title_case("o_orderpriority")).selectExpr(
        "o_orderkey", "o_custkey", "year(o_orderdate) AS fiscal_year", "position"
    )
    records = t.lineitem.selectExpr(
        "l_orderkey",
        "l_partkey",
        "l_extendedprice AS base_salary",
        "l_extendedprice * (1 - l_discount) AS gross_paid",
        "l_extendedprice * l_tax AS overtime_paid",
        "l_extendedprice * l_discount AS additional_pay",
        "l_quantity AS regular_hours",
        "l_quantity * l_tax AS overtime_hours",
        "CASE l_returnflag WHEN 'A' THEN 'per Annum' WHEN 'R' THEN 'per Hour' ELSE 'per Day' END AS pay_basis",
        "CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN DATE '9999-12-31' ELSE to_date(l_shipdate) END AS start_date",
    )
    # Orders meet customers first, so that line items are shuffled only once.
    held = jobs.join(people, F.col("o_custkey") == F.col("c_custkey"))
    return records.join(held, F.col("l_orderkey") == F.col("o_orderkey"))


# Which fuel a part type stands for; the other fuels stay unused.
FUEL_OF_TYPE = {
    "ECONOMY": "bio_diesel",
    "LARGE": "diesel_fuel",
    "MEDIUM": "electric_battery",
    "PROMO": "electric_propulsion",
    "SMALL": "gasoline",
    "STANDARD": "liquified_nat_gas",
}


def energy_raw(t: Tables) -> DataFrame:
    """Fuel use per supplier, mode and service type, numbers as text and ``-`` for none.

    All line items count, 256 of their units as one. Every tenth supplier reports under another
    number, so that some agencies have no fuel data; every seventh has two modes, not three.
    """
    from ..sources.dimensions import FUELS

    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    two_modes = (F.col("l_suppkey") % 7 == 0) & (F.col("l_returnflag") == "N")
    mode = F.when((F.col("l_returnflag") == "A") | two_modes, "MB").when(F.col("l_returnflag") == "N", "DR").otherwise("ZZ")
    type_of = {fuel: kind for kind, fuel in FUEL_OF_TYPE.items()}

    def amount(fuel: str):
        if fuel not in type_of:
            return F.lit("-")
        total = F.sum(F.when(F.col("p_type") == type_of[fuel], F.col("l_quantity")))
        return F.coalesce((total / 256).cast("string"), F.lit("-"))

    grouped = rows.groupBy(F.col("l_suppkey"), mode.alias("mode"), F.col("l_linestatus").alias("tos"))
    sums = grouped.agg(*[amount(f).alias(f) for f in FUELS if f in type_of])
    return sums.select(
        F.when(F.col("l_suppkey") % 10 == 0, F.concat(F.lit("9"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
        .otherwise(F.col("l_suppkey").cast("string"))
        .alias("ntd_id"),
        F.concat(F.lit("Agency "), F.col("l_suppkey")).alias("agency"),
        "mode",
        "tos",
        F.lit("Full Reporter").alias("reporter_type"),
        F.lit("Urban").alias("reporting_module"),
        F.lit("-").alias("other_fuel"),
        F.lit(None).cast("string").alias("other_fuel_description"),
        *[F.col(f) if f in type_of else amount(f).alias(f) for f in FUELS],
    )


def service_raw(t: Tables) -> DataFrame:
    """Line items counted as trips, quantities as miles, per supplier."""
    sums = t.lineitem.groupBy("l_suppkey").agg(
        F.count("*").cast("double").alias("sum_unlinked_passenger_trips_upt"), F.sum("l_quantity").alias("sum_passenger_miles")
    )
    return t.supplier.join(sums, F.col("s_suppkey") == F.col("l_suppkey"), "left").select(
        F.col("s_suppkey").cast("string").alias("_5_digit_ntd_id"),
        F.col("s_name").alias("agency"),
        F.concat(F.lit("City "), F.col("s_suppkey") % 10).alias("max_city"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("max_state"),
        "sum_unlinked_passenger_trips_upt",
        "sum_passenger_miles",
        F.col("s_acctbal").alias("total_trips"),
    )


def profile_pages(t: Tables) -> DataFrame:
    """An HTML page per nation with a key/value table about its customers."""
    from ..operators.aggregates import group_mode

    stats = t.customer.groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count("*").alias("n"))
    source = group_mode(t.customer, ["c_nationkey"], "c_mktsegment", "source").drop("n")
    rows = t.nation.join(stats, F.col("n_nationkey") == F.col("c_nationkey")).drop("c_nationkey")
    rows = rows.join(source, F.col("n_nationkey") == F.col("c_nationkey"))

    def line(item: str, value, rank):
        return F.concat(F.lit(f"<tr><td>{item}</td><td>"), value, F.lit("</td><td>"), rank, F.lit("</td></tr>"))

    none = F.lit("")
    page = F.concat(
        F.lit("<html><body><h1>Profile</h1><table><tr><th>Item</th><th>Value</th><th>U.S. rank</th></tr>"),
        line("Primary energy source", none, F.col("source")),
        line("Net generation (megawatthours)", F.format_number(F.col("n") * 1234567, 0), none),
        line("Average retail price (cents/kWh)", F.round(F.col("mean") / 400, 2).cast("string"), none),
        line("Carbon dioxide (lbs/MWh)", F.format_number(F.col("mean") / 5, 0), none),
        F.lit("</table><table><tr><th>Other</th></tr><tr><td>1</td></tr></table></body></html>"),
    )
    return rows.select(
        F.col("n_name").alias("state"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("abbreviation"), page.alias("page")
    )


def territories(t: Tables) -> DataFrame:
    """Nations and regions as the list of states to cover."""
    nations = t.nation.select(
        F.col("n_name").alias("state"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("abbreviation"), F.col("n_nationkey").alias("position")
    )
    regions = t.region.select(
        F.col("r_name").alias("state"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("abbreviation"), (F.col("r_regionkey") + 100).alias("position")
    )
    return nations.unionByName(regions)


def songs_raw(t: Tables) -> DataFrame:
    """Parts as songs, some with two artists. Promotional ones have identifiers that no play has."""
    key = F.col("p_partkey")
    artists = F.when(F.col("p_size") > 45, F.concat(F.lit("['"), F.col("p_brand"), F.lit("', 'Guest']"))).otherwise(
        F.concat(F.lit("['"), F.col("p_brand"), F.lit("']"))
    )
    own = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("promo-"), key)).otherwise(key.cast("string"))
    return t.part.select(
        own.alias("id"),
        artists.alias("artists"),
        (F.col("p_size") + 1950).alias("year"),
        (F.col("p_size") * 2.0).alias("popularity"),
        (F.col("p_size") / 50.0).alias("danceability"),
        ((key % 97) / 97.0).alias("acousticness"),
        ((key % 89) / 89.0).alias("energy"),
        ((key % 83) / 83.0).alias("valence"),
        ((key % 7) / 7.0).alias("instrumentalness"),
        F.col("p_retailprice").alias("tempo"),
        F.col("p_type").alias("key"),
    )


def plays(t: Tables, lists: bool = False) -> DataFrame:
    """Orders as playlists of parts; ``lists`` adds the columns that only orders hold."""
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    own = []
    if lists:
        rows = rows.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        own = [
            F.concat(F.lit("List "), F.col("o_custkey")).alias("playlist_name"),
            F.col("o_totalprice").alias("playlist_followers"),
        ]
    return rows.select(
        *own,
        F.col("l_orderkey").alias("playlist_id"),
        F.col("l_linenumber").alias("playlist_position"),
        F.concat_ws(" ", "p_name", "p_type").alias("track_name"),
        F.col("l_partkey").cast("string").alias("track_id"),
        F.col("p_brand").alias("artist_name"),
        F.col("p_brand").alias("artist_id"),
        F.col("p_type").alias("album_name"),
        F.col("p_type").alias("album_id"),
        (F.col("l_quantity") * 10000).alias("duration"),
    )


def result_pages(t: Tables, year: int, rival: str) -> DataFrame:
    """An HTML page per nation: a decoy table, then one row per customer segment with its orders as votes."""
    voters = t.orders.where(F.year("o_orderdate") == year).join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    votes = voters.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("rep"),
        F.count_if(F.col("o_orderstatus") == "O").alias("dem"),
        F.count_if(F.col("o_orderstatus") == "P").alias("other"),
        F.count("*").alias("total"),
    )
    numbers = [F.col("rep"), F.col("dem"), F.col("other"), F.col("rep") - F.col("dem"), F.col("total")]
    cells = [F.col("c_mktsegment"), *[F.format_number(n, 0) for n in numbers]]
    row = F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    # A nation has as many rows as there are segments.
    tables = votes.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("rows"))
    head = (
        "<table><tr><th>Candidate</th><th>Votes</th></tr><tr><td>All</td><td>1</td></tr></table>"
        "<table><tr><th>County</th><th>Donald Trump Republican</th><th>" + rival + "</th>"
        "<th>Various candidates Other parties</th><th>Margin</th><th>Total</th></tr>"
        "<tr><th>County</th><th>#</th><th>#</th><th>#</th><th>#</th><th>#</th></tr>"
    )
    page = F.concat(F.lit(f"<html><body>{head}"), F.col("rows"), F.lit("</table></body></html>"))
    named = tables.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("state"), page.alias("page"))


def counties(t: Tables) -> DataFrame:
    """A square per nation and segment; land grows with the nation's key."""
    from ..functions.geometry import square

    places = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    rows = places.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    side = F.col("n_nationkey") + 1
    return rows.select(
        F.col("c_mktsegment").alias("county"),
        F.col("n_name").alias("state"),
        (side * 1e6 + F.length("c_mktsegment")).cast("string").alias("area_land"),
        F.col("n").cast("double").alias("area_water"),
        square(F.col("n_regionkey"), F.col("n_nationkey"), side).alias("geometry"),
    )


def exposure_raw(t: Tables) -> DataFrame:
    """Names and types of small parts as job titles, rated by the size of their latest part."""
    titles = t.part.where(F.col("p_size") < 25).groupBy("p_name", "p_type").agg(
        F.max_by("p_size", "p_partkey").alias("size"), F.count("*").alias("n")
    )
    return titles.select(
        F.concat(F.lit(" "), F.initcap("p_name"), F.lit(" "), F.col("p_type"), F.lit(" ")).alias("Job titiles"),
        F.when(F.col("size") != 23, F.concat(F.col("size"), F.lit("%"))).alias("AI Impact"),
        F.when(F.col("n") != 2, F.col("n").cast("int")).alias("Tasks"),
    )


def outlook_raw(t: Tables) -> DataFrame:
    """Names of large parts as occupations, with the brand of their latest part as education."""
    titles = t.part.where(F.col("p_size") >= 25).groupBy("p_name").agg(
        F.min("p_type").alias("low"), F.max("p_type").alias("high"), F.count("*").alias("n"), F.max("p_size").alias("most"),
        F.max_by("p_brand", "p_partkey").alias("brand"), F.max_by("p_size", "p_partkey").alias("size"),
    )
    education = F.when(F.col("size") >= 30, F.col("brand"))
    return titles.select(
        F.initcap("p_name").alias("Occupation Title"),
        F.lit("00-0000").alias("Occupation Code"),
        F.col("n").cast("string").alias("Employment Change, 2023-2033"),
        F.col("most").cast("string").alias("Employment Percent Change, 2023-2033"),
        F.col("n").cast("string").alias("Occupational Openings, 2023-2033 Annual Average"),
        F.lit("1").alias("Median Annual Wage 2024"),
        education.alias("Typical Entry-Level Education"),
        F.lit("1").alias("Education Code"),
        F.col("low").alias("Work Experience in a Related Occupation"),
        F.lit("1").alias("Workex Code"),
        F.col("high").alias("Typical on-the-job Training"),
        F.lit("1").alias("trCode"),
    )
