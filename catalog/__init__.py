"""Named queries over the given tables, each with its SQL counterpart."""

from .base import ORACLE, QUERIES
from . import cleaning, fleet, flows, places, riders, weather  # noqa: F401

__all__ = ["ORACLE", "QUERIES"]
