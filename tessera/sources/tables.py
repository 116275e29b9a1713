"""Parquet sinks and sources of points and classified points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.cells import stripe_of
from tessera.model import Domain


def write_by_stripe(points: DataFrame, path: str, domain: Domain, n: int) -> None:
    """Points in a folder for each stripe; later reads of some stripes skip the others."""
    from pyspark.sql import functions as F

    points.withColumn("stripe", stripe_of(F.col("x"), domain.min_x, domain.max_x, n)).write.partitionBy("stripe").parquet(path)


def read_stripes(spark: SparkSession, path: str, *stripes: int) -> DataFrame:
    """Points of the given stripes, or of all."""
    df = spark.read.parquet(path)
    return df.where(df["stripe"].isin(*stripes)) if stripes else df
