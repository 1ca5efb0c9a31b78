"""Registered queries over the driver's tables, and their DuckDB equivalents."""

from .registry import oracles, queries

__all__ = ["oracles", "queries"]
