"""Query registry: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE_SQL[name]`` (DuckDB text).

Every query reads the driver's tables whole. Floating results are rounded half-up on the binary value
(``floor(x·10^d + 0.5) / 10^d``) identically on both sides, so sums taken in a different order still agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return wrap


# importing the modules fills the registry
from . import q_advise, q_anomaly, q_bagged, q_cart, q_catalog, q_cluster, q_dbscan, q_knn, q_profile, q_ridge, q_trees  # noqa: E402,F401,I001
