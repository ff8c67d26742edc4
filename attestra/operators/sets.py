"""Unions, differences and drift between tables of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_test_cases(lists: list[DataFrame]) -> DataFrame:
    """One table of labelled lists (SET-1)."""
    return reduce(lambda a, b: a.unionByName(b), lists)


def snapshot_diff(actual: DataFrame, golden: DataFrame, volatile: tuple[str, ...] = ("request_id", "timestamp", "processing_ms")) -> DataFrame:
    """Rows of one side only, volatile columns left out (SET-3)."""
    a, g = actual.drop(*volatile), golden.drop(*volatile)
    return a.exceptAll(g).withColumn("side", F.lit("actual")).unionByName(g.exceptAll(a).withColumn("side", F.lit("golden")))


def hash_drift(current: DataFrame, goldens: DataFrame, key: str = "asset_id") -> DataFrame:
    """Assets whose v1 or v2 hash is no longer the golden one (SET-4)."""
    both = current.select(key, "v1", "v2").join(goldens.select(key, F.col("v1").alias("golden_v1"), F.col("v2").alias("golden_v2")), key)
    return both.filter(~F.col("v1").eqNullSafe(F.col("golden_v1")) | ~F.col("v2").eqNullSafe(F.col("golden_v2")))


def combine_indicators(parts: dict[str, Column]) -> Column:
    """Arrays of indicators in one, each with its source's prefix (SET-5)."""


    def named(prefix: str, items: Column) -> Column:
        return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{prefix}: "), x))

    return F.concat(*[named(p, c) for p, c in parts.items()])
