"""Literal lookup tables. Each is small by definition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Pounds of CO2 per unit of fuel.
EMISSION_FACTORS = {
    "bio_diesel": 22.45,
    "bunker_fuel": 24.78,
    "c_natural_gas": 18.32,
    "diesel_fuel": 22.45,
    "electric_battery": 0.0,
    "electric_propulsion": 0.0,
    "ethanol": 19.94,
    "methonal": 19.94,
    "gasoline": 20.86,
    "hydrogen": 0.0,
    "kerosene": 21.78,
    "liquified_nat_gas": 120.85,
    "liquified_petroleum_gas": 33.04,
}
FUELS = list(EMISSION_FACTORS)
ELECTRIC_FUELS = ["electric_battery", "electric_propulsion"]

# Transit mode codes.
TRANSIT_MODES = {
    "DR": "Demand Response",
    "FB": "Ferryboat",
    "MB": "Motorbus",
    "SR": "Street Car Rail",
    "TB": "Trolleybus",
    "VP": "Vanpool",
    "CB": "Commuter Bus",
    "RB": "Rapid Bus",
    "LR": "Light Rail",
    "MG": "Monorail Guideway",
    "CR": "Commuter Rail",
    "AR": "Alaska Railroad",
    "TR": "Aerial Tramway",
    "HR": "Heavy Rail",
    "YR": "Hybrid Rail",
    "IP": "Inclined Plane Vehicle",
    "PB": "Publico Mode",
    "CC": "Cable Car",
}

# Names and postal codes of the 50 states.
US_STATES = {
    "Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA",
    "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "Florida": "FL", "Georgia": "GA",
    "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA",
    "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD",
    "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO",
    "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ",
    "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH",
    "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC",
    "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT",
    "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY",
}

# How two far states are scaled and moved next to the others.
STATE_MOVES = {"Hawaii": (0.35, 40.0, -15.0), "Alaska": (0.35, 55.0, -15.0)}


def lookup(spark: SparkSession, mapping: dict[str, str], key: str, value: str) -> DataFrame:
    """A mapping as a two-column table, with its order in ``position``."""
    rows = [(k, v, i) for i, (k, v) in enumerate(mapping.items(), 1)]
    return spark.createDataFrame(rows, f"{key} string, {value} string, position int")


def states(spark: SparkSession) -> DataFrame:
    return lookup(spark, US_STATES, "state", "abbreviation")
