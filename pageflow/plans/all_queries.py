"""Importing this module registers every query."""

from pageflow.plans import assembly, layout, library, orientation, progress, review  # noqa: F401
from pageflow.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
