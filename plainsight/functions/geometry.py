"""Planar geometry over rings held as ``array<array<struct<x, y>>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .missing import as_col


def point(x, y) -> Column:
    return F.struct(as_col(x).cast("double").alias("x"), as_col(y).cast("double").alias("y"))


def square(x, y, side) -> Column:
    """One closed ring: an axis-parallel square with lower left corner (x, y)."""
    x, y, side = as_col(x), as_col(y), as_col(side)
    return F.array(
        F.array(
            point(x, y), point(x + side, y), point(x + side, y + side), point(x, y + side), point(x, y)
        )
    )


def affine(rings: Column | str, scale, dx, dy) -> Column:
    """Scale every point, then move it."""
    scale, dx, dy = as_col(scale), as_col(dx), as_col(dy)
    return F.transform(
        as_col(rings),
        lambda ring: F.transform(ring, lambda p: point(p["x"] * scale + dx, p["y"] * scale + dy)),
    )


def _moments(ring: Column) -> Column:
    """Twice the signed area and six times the first moments of one closed ring.

    Taken relative to the first point, which keeps precision far from the origin.
    """
    origin = F.try_element_at(ring, F.lit(1))
    sides = F.arrays_zip(
        F.slice(ring, F.lit(1), F.greatest(F.size(ring) - 1, F.lit(0))).alias("a"),
        F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))).alias("b"),
    )
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, side):
        ax, ay = side["a"]["x"] - origin["x"], side["a"]["y"] - origin["y"]
        bx, by = side["b"]["x"] - origin["x"], side["b"]["y"] - origin["y"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["c"] + cross).alias("c"),
            (acc["mx"] + (ax + bx) * cross).alias("mx"),
            (acc["my"] + (ay + by) * cross).alias("my"),
        )

    return F.aggregate(
        sides,
        zero,
        step,
        lambda acc: F.struct(
            acc["c"].alias("c"),
            (acc["mx"] + 3 * origin["x"] * acc["c"]).alias("mx"),
            (acc["my"] + 3 * origin["y"] * acc["c"]).alias("my"),
        ),
    )


def centroid(rings: Column | str) -> Column:
    """Area centroid as ``struct<x, y>``; holes run against their outer ring. NULL without area."""
    parts = F.transform(as_col(rings), _moments)
    zero = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(
        parts,
        zero,
        lambda acc, m: F.struct(
            (acc["c"] + m["c"]).alias("c"), (acc["mx"] + m["mx"]).alias("mx"), (acc["my"] + m["my"]).alias("my")
        ),
        lambda acc: F.when(
            acc["c"] != 0,
            F.struct((acc["mx"] / (3 * acc["c"])).alias("x"), (acc["my"] / (3 * acc["c"])).alias("y")),
        ),
    )
