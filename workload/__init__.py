"""Registered queries over the given tables, each with an equivalent SQL statement where possible."""

from . import access, catalogs, coarse, combination, cross, elementwise, long_windows, prepare, rolling, scores, selection
from . import split  # after the queries it repeats
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
