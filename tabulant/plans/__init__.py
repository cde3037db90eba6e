"""Registered queries on the driver tables and their DuckDB oracle SQL."""

from .catalog import QUERIES
from .oracle import ORACLE_SQL

__all__ = ["QUERIES", "ORACLE_SQL"]
