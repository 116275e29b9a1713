"""Generators of polygons and points; all are functions of a row's id, so they are parallel and repeatable."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G
from tessera.model import Domain

#: Bounds of the real-world point sets: longitude and latitude (fixed values).
REAL_BOUNDS = Domain(60.87, 23.63, 77.84, 37.10)
#: Spread of a cluster as a share of the domain, and the number of clusters (fixed values).
SIGMA, CLUSTERS = 0.015, 5
#: Points of a batch and the step of its seed (fixed values).
BATCH, SEED_STEP = 250_000, 104_729


def grid(spark: SparkSession, nx: int, ny: int, domain: Domain = Domain()) -> DataFrame:
    """nx * ny rectangles, numbered by row from the lower left, corners counter-clockwise."""
    w, h = (domain.max_x - domain.min_x) / nx, (domain.max_y - domain.min_y) / ny
    col, row = F.col("id") % nx, F.floor(F.col("id") / nx)
    x = lambda k: F.lit(float(domain.min_x)) + (col + k).cast("double") * F.lit(w)
    y = lambda k: F.lit(float(domain.min_y)) + (row + k).cast("double") * F.lit(h)
    corner = lambda i, j: F.struct(x(i).alias("x"), y(j).alias("y"))
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    return spark.range(nx * ny).select(F.col("id").alias("polygon_id"), F.lit(0).alias("part_no"), ring.alias("exterior"), F.array().cast(f"array<array<{G.VERTEX}>>").alias("holes"))


def _unit(seed: int, k: int):
    """A number in [0, 1) from the id, the seed and k."""
    return F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11).cast("double") * F.lit(2.0**-53)


def _points(spark: SparkSession, n: int, x, y) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("point_id"), x.alias("x"), y.alias("y"))


def uniform(spark: SparkSession, n: int, domain: Domain = Domain(), seed: int = 42) -> DataFrame:
    """Points uniform over the domain."""
    x = F.lit(domain.min_x) + _unit(seed, 1) * F.lit(domain.max_x - domain.min_x)
    y = F.lit(domain.min_y) + _unit(seed, 2) * F.lit(domain.max_y - domain.min_y)
    return _points(spark, n, x, y)


def centres(k: int = CLUSTERS, domain: Domain = Domain(), seed: int = 42) -> list[tuple[float, float]]:
    """Cluster centres uniform over the domain."""
    r = random.Random(seed)
    return [(r.uniform(domain.min_x, domain.max_x), r.uniform(domain.min_y, domain.max_y)) for _ in range(k)]


def clustered(spark: SparkSession, n: int, domain: Domain = Domain(), seed: int = 42, k: int = CLUSTERS, sigma: float = SIGMA) -> DataFrame:
    """Points normal about equally likely centres (Box-Muller), clamped to the domain."""
    table = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in centres(k, domain, seed)])
    centre = F.get(table, F.floor(_unit(seed, 3) * k).cast("int"))
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - _unit(seed, 4)))
    angle = F.lit(6.283185307179586) * _unit(seed, 5)
    clamp = lambda v, low, high: F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))
    x = clamp(centre.x + radius * F.cos(angle) * F.lit(sigma * (domain.max_x - domain.min_x)), domain.min_x, domain.max_x)
    y = clamp(centre.y + radius * F.sin(angle) * F.lit(sigma * (domain.max_y - domain.min_y)), domain.min_y, domain.max_y)
    return _points(spark, n, x, y)


def batched(points: DataFrame, size: int = BATCH, seed: int = 42) -> DataFrame:
    """Adds batch_id and batch_seed: consecutive ids in batches, each with a seed of its own."""
    batch = F.floor(F.col("point_id") / size).cast("bigint")
    return points.withColumns({"batch_id": batch, "batch_seed": F.lit(seed).cast("bigint") + batch * SEED_STEP})
