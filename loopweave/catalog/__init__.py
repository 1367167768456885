"""Queries over the given tables, each with the equivalent SQL where there is one."""

from loopweave.catalog import files, fitted, graphs, models, resampling, scores, signals, vectors  # noqa: F401
from loopweave.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
