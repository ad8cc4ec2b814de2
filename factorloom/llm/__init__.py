"""Operators for large text corpora, and one registered query for each."""

from .queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
