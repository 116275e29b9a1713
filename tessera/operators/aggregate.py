"""Aggregates over classified points; all are partial and merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions.fingerprint import hex64, with_fingerprint
from tessera.model import Domain, prepared


def partials(classified: DataFrame, *by: str) -> DataFrame:
    """points, matched, unmatched and checksum (bigint, to be merged by bit_xor)."""
    return with_fingerprint(classified).groupBy(*by).agg(*_measures())


def _measures() -> list[Column]:
    return [
        F.count("*").alias("points"),
        F.count("polygon_id").alias("matched"),
        F.count_if(F.col("polygon_id").isNull()).alias("unmatched"),
        F.coalesce(F.bit_xor("fingerprint"), F.lit(0).cast("bigint")).alias("checksum"),
    ]


def summary(classified: DataFrame, *by: str) -> DataFrame:
    """One row (or one for each key) with counts and the checksum in hex."""
    return partials(classified, *by).withColumn("checksum", hex64(F.col("checksum")))


def merged(parts: DataFrame, *by: str) -> DataFrame:
    """Sums and xors partial aggregates."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("points", "matched", "unmatched")]
    return parts.groupBy(*by).agg(*sums, F.coalesce(F.bit_xor("checksum"), F.lit(0).cast("bigint")).alias("checksum")).withColumn("checksum", hex64(F.col("checksum")))


def per_stripe(classified: DataFrame, domain: Domain, n: int) -> DataFrame:
    """Counts and checksum of each stripe."""
    return summary(classified.withColumn("stripe", C.stripe_of(F.col("x"), domain.min_x, domain.max_x, n)), "stripe")


def per_polygon(classified: DataFrame) -> DataFrame:
    """Points of each polygon, with a null polygon for unmatched ones."""
    return classified.groupBy("polygon_id").agg(F.count("*").alias("points"))


def fullest(classified: DataFrame, k: int) -> DataFrame:
    """The k polygons with most points, ties to the smaller id; counts are merged first and k rows of each task after."""
    return per_polygon(classified.where("polygon_id is not null")).orderBy(F.desc("points"), "polygon_id").limit(k)


def imbalance(classified: DataFrame, domain: Domain, n: int) -> DataFrame:
    """Share of each stripe and the largest stripe over the mean."""
    counts = classified.withColumn("stripe", C.stripe_of(F.col("x"), domain.min_x, domain.max_x, n)).groupBy("stripe").agg(F.count("*").alias("points"))
    everything = Window.partitionBy(F.lit(0))  # one row for each stripe, n at most
    return counts.select("stripe", "points", (F.col("points") / F.sum("points").over(everything)).alias("share"), (F.max("points").over(everything) / F.avg("points").over(everything)).alias("imbalance"))


def shard_copies(polygons: DataFrame, domain: Domain, n: int) -> DataFrame:
    """Parts that each stripe holds if it takes all whose closed bounds meet its closed ends, copies included."""
    slots = {side: C.stripe_of(F.col(f"{side}_x"), domain.min_x, domain.max_x, n) for side in ("min", "max")}
    near = prepared(polygons).withColumn("stripe", F.explode(F.sequence(F.greatest(slots["min"] - 1, F.lit(0)), F.least(slots["max"] + 1, F.lit(n - 1)))))
    ends = near.select("min_x", "max_x", "stripe", *C.stripe_bounds(F.col("stripe"), domain.min_x, domain.max_x, n))
    return ends.where(C.meets_stripe(F.col("min_x"), F.col("max_x"), F.col("lo"), F.col("hi"))).groupBy("stripe").agg(F.count("*").alias("polygons"))


def throughput(metrics: DataFrame) -> DataFrame:
    """Adds points_per_s and avg_candidates to rows with points, ms and candidates; null where nothing was timed."""
    return metrics.withColumns({"points_per_s": F.col("points") / F.nullif(F.col("ms") / 1000.0, F.lit(0.0)), "avg_candidates": F.coalesce(F.col("candidates") / F.nullif(F.col("points"), F.lit(0)), F.lit(0.0))})


def speedup(metrics: DataFrame) -> DataFrame:
    """Adds speedup over one worker and efficiency to rows with workers and ms."""
    one = F.first(F.when(F.col("workers") == 1, F.col("ms")), ignorenulls=True).over(Window.partitionBy("experiment"))
    return metrics.withColumn("speedup", one / F.col("ms")).withColumn("efficiency", F.col("speedup") / F.col("workers"))
