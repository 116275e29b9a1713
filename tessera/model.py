"""Data model: points, polygons in parts, and how the parts are prepared for tests.

Points are rows (point_id bigint, x double, y double).  Polygons are rows
(polygon_id bigint, part_no int, exterior array<struct<x,y>>, holes
array<array<struct<x,y>>>); a multipolygon has several parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G

POINTS = "point_id bigint, x double, y double"
POLYGONS = f"polygon_id bigint, part_no int, exterior array<{G.VERTEX}>, holes array<array<{G.VERTEX}>>"


@dataclass(frozen=True)
class Domain:
    """The rectangle that cells divide."""

    min_x: float = 0.0
    min_y: float = 0.0
    max_x: float = 100.0
    max_y: float = 100.0


def polygons(spark: SparkSession, rows: list[tuple[int, int, list, list]]) -> DataFrame:
    """Polygons from (polygon_id, part_no, exterior, holes) with (x, y) vertices."""
    ring = lambda vs: [(float(x), float(y)) for x, y in vs]
    return spark.createDataFrame([(i, p, ring(e), [ring(h) for h in hs]) for i, p, e, hs in rows], POLYGONS)


def prepared(polys: DataFrame) -> DataFrame:
    """Parts with bounds, edges and whether they are plain rectangles; parts without bounds are left out.

    Columns: polygon_id, part_no, min_x, min_y, max_x, max_y, box, outer, inner.
    """
    ring = G.open_ring(F.col("exterior"))
    holes = F.transform(F.coalesce("holes", F.array().cast(f"array<array<{G.VERTEX}>>")), G.open_ring)
    rings = polys.select("polygon_id", "part_no", ring.alias("ring"), holes.alias("holes"))
    box = G.is_box(F.col("ring")) & (F.size("holes") == 0)
    out = rings.select(
        "polygon_id",
        "part_no",
        *G.bounds(F.col("ring")),
        box.alias("box"),
        F.when(box, F.array().cast(f"array<{G.EDGE}>")).otherwise(G.edges(F.col("ring"))).alias("outer"),
        F.transform("holes", G.edges).alias("inner"),
    )
    return out.where("min_x is not null")


def multipolygon_bounds(polys: DataFrame) -> DataFrame:
    """Union of each polygon's part bounds."""
    parts = polys.select("polygon_id", *G.bounds(G.open_ring(F.col("exterior"))))
    return parts.groupBy("polygon_id").agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"))
