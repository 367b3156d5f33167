"""The registered queries."""

from . import (  # noqa: F401
    aggregates,
    election,
    filters,
    jobs,
    joins,
    nested,
    payroll,
    playlist,
    projections,
    ranking,
    scalars,
    scans,
    transit,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
