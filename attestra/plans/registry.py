"""Every query of the library with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, core, detectors, lifecycles, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (core, analytics, rules, detectors, lifecycles):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
