"""Registry of named queries: a DataFrame builder and, where SQL can express it, the SQL with the same result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of this folder that register queries.
MODULES: tuple[str, ...] = ("segment_queries", "fit_queries", "curve_queries", "parameter_queries")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found |= importlib.import_module(f"voltlake.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= importlib.import_module(f"voltlake.plans.{name}").ORACLE
    return found
