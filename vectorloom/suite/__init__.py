"""Registered queries: every operator on the driver tables, with SQL to check it."""

from vectorloom.suite.base import ORACLES, QUERIES
from vectorloom.suite import (  # noqa: F401  (registration by import)
    evaluation,
    index,
    inputs,
    layout,
    quality,
    registry,
    search,
    streams,
)

__all__ = ["ORACLES", "QUERIES"]
