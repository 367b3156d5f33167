"""Elections: county results of two years, shifts, density, turnout, and the shift map.

A result table has ``county, state, republican, democratic, other, margin,
total``, all text as published. Counties have ``county, state, area_land,
area_water, geometry`` with geometry as rings of points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import missing as M
from ..functions.numbers import share_shift, square_miles
from ..functions.text import comma_number, parse_number, slug
from ..operators import joins as J
from ..operators import ranking as R
from ..sources import html
from ..sources.dimensions import STATE_MOVES

# Table headings that mark county results, and their columns.
COUNTY_HEADINGS = "County|Parish|Borough|Area|Region|District"
COLUMNS_2024 = {
    "county": "county",
    "donald_trump_republican": "republican",
    "kamala_harris_democratic": "democratic",
    "various_candidates_other_parties": "other",
    "margin": "margin",
    "total": "total",
}
COLUMNS_2020 = {
    "county": "county",
    "donald_trump_republican": "republican",
    "joe_biden_democratic": "democratic",
    "various_candidates_other_parties": "other",
    "margin": "margin",
    "total": "total",
}
PAGE_OF_STATE = {"Washington": "Washington_(state)"}
MAP_SHIFT_SCALE = 5.0
VOTES = ["republican", "democratic", "other", "margin", "total"]


def page_name(state: Column | str, year: int) -> Column:
    """Name of the page that holds a state's results."""
    return F.concat(F.lit(f"{year}_United_States_presidential_election_in_"), slug(state, PAGE_OF_STATE))


def results(pages: DataFrame, columns: Mapping[str, str], subheader_rows: int = 1) -> DataFrame:
    """``(state, page)`` rows to county results, without each table's sub-header row.

    Pages without a county table give no rows.
    """
    picked = html.with_clean_header(html.pick_table(html.html_tables("page"), COUNTY_HEADINGS))
    rows = html.table_rows(pages.select("state", picked.alias("tbl")), "tbl", dict(columns))
    rows = rows.where(F.col("county").isNotNull() & (F.col("row_no") > subheader_rows))
    return rows.select("county", "state", *VOTES)


def merge(new: DataFrame, old: DataFrame, counties: DataFrame) -> DataFrame:
    """Both years and the county's land, for counties found in all three."""
    keys = ["county", "state"]
    both = J.join(new, old, keys, "inner", suffixes=("_2024", "_2020"))
    return J.join(both, counties, keys, "inner")


def _top(df: DataFrame, by: str, n: int) -> DataFrame:
    return R.top_n(df, n, M.desc(by), F.asc("county"), F.asc("state"))


def top_votes(merged: DataFrame, n: int = 10) -> DataFrame:
    rows = merged.select("county", "state", comma_number("republican_2024").alias("votes"))
    return _top(rows, "votes", n)


def top_share(merged: DataFrame, n: int = 10) -> DataFrame:
    votes = merged.select("county", "state", parse_number("democratic_2020").alias("votes"), parse_number("total_2020").alias("total"))
    rows = votes.withColumn("share", F.round(M.ratio("votes", "total"), 3))
    return _top(rows.where(~M.is_missing("share")), "share", n)


def top_shift(merged: DataFrame, n: int = 10) -> DataFrame:
    shift = comma_number("republican_2024") - comma_number("republican_2020")
    rows = merged.select("county", "state", shift.alias("shift"))
    return _top(rows.where(F.col("shift").isNotNull()), "shift", n)


def state_shift(merged: DataFrame, n: int = 10, largest: bool = True) -> DataFrame:
    sums = merged.groupBy("state").agg(
        M.sum0(parse_number("republican_2024")).alias("votes_2024"), M.sum0(parse_number("republican_2020")).alias("votes_2020")
    )
    rows = sums.withColumn("shift", F.col("votes_2024") - F.col("votes_2020"))
    return R.top_n(rows, n, M.desc("shift") if largest else M.asc("shift"), F.asc("state"))


def largest_area(merged: DataFrame) -> DataFrame:
    rows = merged.select("county", "state", F.col("area_land").try_cast("double").alias("area_land"))
    top = _top(rows.where(F.col("area_land").isNotNull()), "area_land", 1)
    return top.withColumn("square_miles", F.round(square_miles("area_land"), 2))


def densest(merged: DataFrame) -> DataFrame:
    rows = merged.select(
        "county",
        "state",
        parse_number("total_2020").alias("votes"),
        square_miles(F.col("area_land").try_cast("double")).alias("square_miles"),
    )
    rows = rows.withColumn("density", M.ratio("votes", "square_miles"))
    return _top(rows.where(~M.is_missing("density") & (F.col("square_miles") > 0)), "density", 1)


def turnout(merged: DataFrame) -> DataFrame:
    increase = parse_number("total_2024") - parse_number("total_2020")
    rows = merged.select("county", "state", increase.alias("increase"))
    return _top(rows.where(F.col("increase").isNotNull()), "increase", 1)


def reposition(df: DataFrame, key: str, geometry: str, moves: Mapping[str, tuple[float, float, float]] = STATE_MOVES) -> DataFrame:
    """Scale and move the geometry of the named entities; others stay."""
    k = F.col(key)
    moved = F.col(geometry)
    for name, (scale, dx, dy) in moves.items():
        shifted = G.affine(geometry, F.lit(float(scale)), F.lit(float(dx)), F.lit(float(dy)))
        moved = F.when(k == name, shifted).otherwise(moved)
    return df.withColumn(geometry, moved)


def arrows(df: DataFrame, geometry: str, scale: float = MAP_SHIFT_SCALE) -> DataFrame:
    """Horizontal arrows from each centroid, as long as the shift."""
    rows = df.withColumn("_c", G.centroid(geometry))
    rows = rows.withColumn("lon", F.col("_c.x")).withColumn("lat", F.col("_c.y")).drop("_c")
    known = rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~M.is_missing("shift"))
    return known.withColumn("xend", F.col("lon") + F.col("shift") * scale).withColumn("yend", F.col("lat"))


def shift_map(merged: DataFrame, moves: Mapping[str, tuple[float, float, float]] = STATE_MOVES) -> DataFrame:
    shift = share_shift(*[parse_number(c) for c in ("republican_2024", "total_2024", "republican_2020", "total_2020")])
    rows = reposition(merged.withColumn("shift", shift), "state", "geometry", moves)
    return arrows(rows, "geometry").select("county", "state", "shift", "lon", "lat", "xend", "yend")
