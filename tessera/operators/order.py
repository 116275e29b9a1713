"""Orderings and partitionings of points; none changes a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.model import Domain

SCHEDULES = ("sequential", "static", "dynamic", "tiled", "work_stealing", "hybrid")


def _z(points: DataFrame, d: Domain) -> DataFrame:
    return points.withColumn("_z", C.morton(F.col("x"), F.col("y"), (d.min_x, d.min_y, d.max_x, d.max_y)))


def morton_sorted(points: DataFrame, domain: Domain, partitions: int | None = None) -> DataFrame:
    """Points in Z-order over range partitions."""
    keyed = _z(points, domain)
    dealt = keyed.repartitionByRange(partitions, "_z") if partitions else keyed.repartitionByRange("_z")
    return dealt.sortWithinPartitions("_z").select(*points.columns)


def tile_of(points: DataFrame, domain: Domain, bits: int = 16) -> DataFrame:
    """Adds tile: a point's Morton code without its low bits."""
    return _z(points, domain).withColumn("tile", F.shiftright("_z", bits)).drop("_z")


def scheduled(points: DataFrame, kind: str, domain: Domain = Domain()) -> DataFrame:
    """Points dealt to tasks as a schedule says.

    sequential: one task.  static: one partition for each core.  dynamic and
    work_stealing: several smaller ones that idle cores take (8 and 4 for each
    core).  tiled: range partitions in Z-order.  hybrid: four fifths in one
    partition for each core, the rest in small ones.
    """
    cores = points.sparkSession.sparkContext.defaultParallelism
    if kind == "sequential":
        return points.coalesce(1)
    if kind == "static":
        return points.repartition(cores)
    if kind == "dynamic":
        return points.repartition(8 * cores)
    if kind == "work_stealing":
        return points.repartition(4 * cores)
    if kind == "tiled":
        return morton_sorted(points, domain)
    if kind == "hybrid":
        part = F.pmod(F.xxhash64(*points.columns), F.lit(5))
        return points.where(part < 4).repartition(cores).unionByName(points.where(part == 4).repartition(4 * cores))
    raise ValueError(f"unknown schedule {kind!r}; one of {', '.join(SCHEDULES)}")
