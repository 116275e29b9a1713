"""GeoJSON polygons and centroids.

Coordinates are read as text and parsed by geometry type, as schema inference
would merge polygons and multipolygons into one wrong depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as G

FEATURE = "struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>"
COLLECTION = f"features array<{FEATURE}>"


def read(spark: SparkSession, path: str, *fallback: str) -> DataFrame:
    """Features of the first path that can be read: rows feature_no, properties, geometry."""
    for one in (path, *fallback):
        try:
            return features(spark.read.schema(COLLECTION).option("multiLine", True).option("mode", "FAILFAST").json(one))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) or one == (path, *fallback)[-1]:
                raise
    raise AssertionError("unreachable")


def from_text(df: DataFrame, column: str = "json") -> DataFrame:
    """Features of collections held as text."""
    return features(df.select(F.from_json(column, COLLECTION, {"mode": "FAILFAST"}).alias("c")).select("c.features"))


def features(collections: DataFrame) -> DataFrame:
    """One row for each feature."""
    return collections.select(F.posexplode("features").alias("feature_no", "f")).select(F.col("feature_no").cast("bigint").alias("feature_no"), "f.properties", "f.geometry")


def _rings(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda ring: G.open_ring(F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))))


def polygons(feats: DataFrame, flatten: bool = False) -> DataFrame:
    """Polygons of Polygon and MultiPolygon features; with ``flatten`` each part gets an id of its own."""
    text = F.col("geometry.coordinates")
    one = F.array(F.from_json(text, "array<array<array<double>>>"))
    parts = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    rows = feats.select(F.col("feature_no").alias("polygon_id"), F.posexplode(parts).alias("part_no", "part")).select("polygon_id", "part_no", _rings(F.col("part")).alias("rings"))
    out = rows.select("polygon_id", "part_no", F.get("rings", F.lit(0)).alias("exterior"), F.slice("rings", F.lit(2), F.greatest(F.size("rings") - 1, F.lit(0))).alias("holes"))
    if flatten:  # 2**20 parts of a feature at most
        out = out.select((F.shiftleft("polygon_id", 20) + F.col("part_no")).alias("polygon_id"), F.lit(0).alias("part_no"), "exterior", "holes")
    return out


def centroids(feats: DataFrame) -> DataFrame:
    """Points of Point geometries or, without one, of the properties x_coord and y_coord (numbers or text)."""
    point = F.when(F.col("geometry.type") == "Point", F.from_json("geometry.coordinates", "array<double>"))
    own = lambda k, name: F.coalesce(F.get(point, F.lit(k)), F.col("properties")[name].try_cast("double"))
    return feats.select(F.col("feature_no").alias("point_id"), own(0, "x_coord").alias("x"), own(1, "y_coord").alias("y")).where("x is not null and y is not null")
