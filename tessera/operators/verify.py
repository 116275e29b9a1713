"""Comparison of results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows point_id, left, right where two classifications differ or one lacks a point."""
    one = a.select("point_id", F.col("polygon_id").alias("left"), F.lit(True).alias("in_a"))
    two = b.select("point_id", F.col("polygon_id").alias("right"), F.lit(True).alias("in_b"))
    both = one.join(two, "point_id", "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")) | F.col("in_a").isNull() | F.col("in_b").isNull()).select("point_id", "left", "right")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one has more often than the other."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def agreement(results: dict[str, DataFrame], against: str) -> DataFrame:
    """Rows strategy, mismatches: each result against one of them."""
    counts = [differences(r, results[against]).agg(F.count("*").alias("mismatches")).select(F.lit(name).alias("strategy"), "mismatches") for name, r in results.items() if name != against]
    return reduce(DataFrame.unionAll, counts)
