"""Registered queries over the driver's tables: the Spark plan and, where SQL can express it, the oracle SQL."""

from .registry import ORACLE_SQL, QUERIES  # noqa: F401
