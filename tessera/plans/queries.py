"""Registered queries: one for each operator and strategy."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions import geometry as G
from tessera.functions.fingerprint import hex64, with_mixed
from tessera.model import POINTS, Domain, multipolygon_bounds
from tessera.operators import aggregate as A
from tessera.operators import join as J
from tessera.operators import order, quadtree, verify
from tessera.plans import fixtures as X
from tessera.plans import oracle as O
from tessera.sources import binary, generate, geojson
from tessera.streaming import summarise_files

Query = Callable[[SparkSession, str], DataFrame]
D = X.DOMAIN
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Adds a query and its SQL."""
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _classified(spark: SparkSession, sf_dir: str, table: str = "orders", strategy: str = "cells", n: int = 10) -> DataFrame:
    return J.classify(X.points(spark, sf_dir, table), generate.grid(spark, n, n), strategy=strategy)


RESULT = ("point_id", "polygon_id", "cls")
GRID_SQL = f"WITH {O.grid_classified('orders')} SELECT point_id, polygon_id, cls FROM classified"


def _pip_grid(spark: SparkSession, sf_dir: str, strategy: str, table: str = "orders") -> DataFrame:
    return _classified(spark, sf_dir, table, strategy).select(*RESULT)


for _name, _strategy in {
    "strip": "strip", "cells": "cells", "bruteforce": "brute", "stripe_sharded": "sharded", "replicated": "replicated", "quadtree": "quadtree", "morton": "morton",
}.items():
    register(f"pip_grid_{_name}", partial(_pip_grid, strategy=_strategy), GRID_SQL)
register("pip_clustered_grid", partial(_pip_grid, strategy="cells", table="events"), GRID_SQL.replace(X.points_sql("orders"), X.points_sql("events")))
register("pip_embedding_grid", partial(_pip_grid, strategy="cells", table="embeddings"), GRID_SQL.replace(X.points_sql("orders"), X.points_sql("embeddings")))
register("pip_boundary_lattice", partial(_pip_grid, strategy="strip", table="part"), GRID_SQL.replace(X.points_sql("orders"), X.points_sql("part")))


def _pip_shapes(spark: SparkSession, sf_dir: str, table: str, polygons: Callable[[SparkSession], DataFrame], boundary: str = G.INCLUSIVE, strategy: str = "cells") -> DataFrame:
    return J.classify(X.points(spark, sf_dir, table), polygons(spark), strategy=strategy, boundary=boundary).select(*RESULT)


def _shapes_sql(table: str, rows: list, boundary: str = G.INCLUSIVE) -> str:
    return f"WITH {O.shapes_classified(table, rows, boundary)} SELECT point_id, polygon_id, cls FROM classified"


def _only(*ids: int) -> Callable[[SparkSession], DataFrame]:
    return lambda spark: X.shapes(spark).where(F.col("polygon_id").isin(*ids))


def _rows(*ids: int) -> list:
    return [r for r in X.SHAPES if r[0] in ids]


register("pip_shapes_inclusive", partial(_pip_shapes, table="part", polygons=X.shapes), _shapes_sql("part", X.SHAPES))
register("pip_shapes_documented", partial(_pip_shapes, table="part", polygons=X.shapes, boundary=G.DOCUMENTED), _shapes_sql("part", X.SHAPES, G.DOCUMENTED))
register("pip_shapes_class", partial(_pip_shapes, table="orders", polygons=X.shapes, strategy="quadtree"), _shapes_sql("orders", X.SHAPES))
register("pip_holes", partial(_pip_shapes, table="orders", polygons=_only(2)), _shapes_sql("orders", _rows(2)))
register("pip_multipolygon", partial(_pip_shapes, table="orders", polygons=_only(3), strategy="strip"), _shapes_sql("orders", _rows(3)))
register("pip_overlap_minid", partial(_pip_shapes, table="orders", polygons=_only(2, 5)), _shapes_sql("orders", _rows(2, 5)))
register("pip_customer_nation", partial(_pip_shapes, table="customer", polygons=X.nations), _shapes_sql("customer", X.nation_shapes()))


def _semi(spark: SparkSession, sf_dir: str, operator: Callable[..., DataFrame]) -> DataFrame:
    return operator(X.points(spark, sf_dir, "orders"), X.shapes(spark)).select("point_id")


register("points_in_any", partial(_semi, operator=J.points_in_any), f"WITH {O.shapes_classified('orders', X.SHAPES)} SELECT point_id FROM classified WHERE polygon_id IS NOT NULL")
register("points_in_none", partial(_semi, operator=J.points_in_none), f"WITH {O.shapes_classified('orders', X.SHAPES)} SELECT point_id FROM classified WHERE polygon_id IS NULL")

# Aggregates.
SUMMARY_SQL = O.summary_sql(O.grid_classified("events"))
register("agg_summary", lambda s, d: A.summary(_classified(s, d, "events")), SUMMARY_SQL)
register("agg_checksum_hex", lambda s, d: A.summary(_classified(s, d)).select("points", "checksum"), f"SELECT points, checksum FROM ({O.summary_sql(O.grid_classified('orders'))})")
register("agg_per_stripe", lambda s, d: A.per_stripe(_classified(s, d, "events"), D, 4), O.summary_sql(O.grid_classified("events"), O.STRIPE))
register("agg_per_polygon", lambda s, d: A.per_polygon(_classified(s, d, "events")), f"WITH {O.grid_classified('events')} SELECT polygon_id, count(*) AS points FROM classified GROUP BY polygon_id")
register(
    "agg_fullest_polygons",
    lambda s, d: A.fullest(_classified(s, d, "events"), 7),
    f"WITH {O.grid_classified('events')} SELECT polygon_id, count(*) AS points FROM classified WHERE polygon_id IS NOT NULL GROUP BY polygon_id ORDER BY points DESC, polygon_id LIMIT 7",
)
register(
    "agg_imbalance",
    lambda s, d: A.imbalance(_classified(s, d, "events"), D, 4),
    f"""WITH {O.grid_classified("events")}, n AS (SELECT {O.STRIPE} AS stripe, count(*) AS points FROM classified c GROUP BY 1)
SELECT stripe, points, points / CAST(sum(points) OVER () AS DOUBLE) AS share, max(points) OVER () / avg(points) OVER () AS imbalance FROM n""",
)


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    hits = J.classify(X.points(spark, sf_dir, "orders"), X.nations(spark)).where("polygon_id is not null")
    counts = A.per_polygon(hits)  # 25 rows at most, before any join
    named = counts.join(nation, counts.polygon_id == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return named.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.sum("points").cast("bigint").alias("points"))


register(
    "agg_rollup_region_nation",
    _rollup,
    f"""WITH {O.shapes_classified("orders", X.nation_shapes())}
SELECT r_name AS region, n_name AS nation, CAST(count(*) AS BIGINT) AS points
FROM classified JOIN nation ON polygon_id = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
)
register(
    "shard_copies",
    lambda s, d: A.shard_copies(generate.grid(s, 100, 100), D, 4),
    """SELECT CAST(s AS INTEGER) AS stripe, count(*) AS polygons FROM range(10000) t(i) JOIN range(4) u(s)
  ON i % 100 + 1 >= 25 * s AND i % 100 <= 25 * (s + 1) GROUP BY s""",
)
register(
    "strip_candidates",
    lambda s, d: J.candidates(X.points(s, d, "orders"), generate.grid(s, 10, 10), "strip").groupBy("point_id").agg(F.count("polygon_id").alias("candidates")),
    f"""WITH p AS ({X.points_sql("orders")}), g AS ({O.grid_sql()})
SELECT p.point_id, count(g.polygon_id) AS candidates FROM p LEFT JOIN g ON p.x BETWEEN g.min_x AND g.max_x AND p.y BETWEEN g.min_y AND g.max_y GROUP BY p.point_id""",
)


def _candidate_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = J.candidates(X.points(spark, sf_dir, "orders"), generate.grid(spark, 10, 10), "quadtree").where("polygon_id is not null")
    totals = found.agg(F.count("*").alias("candidates"), F.countDistinct("point_id").alias("points"))
    return A.throughput(totals.withColumn("ms", F.lit(1000.0))).select("points", "candidates", "avg_candidates", "points_per_s")


register("agg_avg_candidates", _candidate_share)

# Bounds, grids and generators.
_BOUNDS = ("min_x", "min_y", "max_x", "max_y")
register(
    "polygon_bbox",
    lambda s, d: X.shapes(s).select("polygon_id", "part_no", *G.bounds(G.open_ring(F.col("exterior")))),
    f"""SELECT CAST(i AS BIGINT) AS polygon_id, CAST(p AS INTEGER) AS part_no, CAST(min(ax) AS DOUBLE) AS min_x, CAST(min(ay) AS DOUBLE) AS min_y, CAST(max(ax) AS DOUBLE) AS max_x, CAST(max(ay) AS DOUBLE) AS max_y
FROM (VALUES {X.edges_sql(X.SHAPES)}) v(i, p, r, ax, ay, bx, by_) WHERE r = 0 GROUP BY i, p""",
)
register(
    "multipolygon_bbox",
    lambda s, d: multipolygon_bounds(X.shapes(s)),
    f"""SELECT CAST(i AS BIGINT) AS polygon_id, CAST(min(ax) AS DOUBLE) AS min_x, CAST(min(ay) AS DOUBLE) AS min_y, CAST(max(ax) AS DOUBLE) AS max_x, CAST(max(ay) AS DOUBLE) AS max_y
FROM (VALUES {X.edges_sql(X.SHAPES)}) v(i, p, r, ax, ay, bx, by_) WHERE r = 0 GROUP BY i""",
)
register(
    "polygon_add_hole",
    lambda s, d: X.shapes(s).where("polygon_id = 2").select("polygon_id", F.size(G.add_hole(F.col("holes"), F.slice("exterior", 1, 3))).cast("bigint").alias("holes")),
    "SELECT CAST(2 AS BIGINT) AS polygon_id, CAST(2 AS BIGINT) AS holes",
)
register("polygon_grid", lambda s, d: generate.grid(s, 10, 10).select("polygon_id", *G.bounds(F.col("exterior"))), O.grid_sql())
register(
    "stripe_bounds",
    lambda s, d: s.range(7).select(F.col("id").alias("stripe"), *C.stripe_bounds(F.col("id"), 0.0, 100.0, 7)),
    """SELECT i AS stripe, CAST(0 AS DOUBLE) + i * (CAST(100 AS DOUBLE) / CAST(7 AS DOUBLE)) AS lo,
  CASE WHEN i = 6 THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) + (i + 1) * (CAST(100 AS DOUBLE) / CAST(7 AS DOUBLE)) END AS hi FROM range(7) t(i)""",
)


def _slot_sql(name: str, axis: str, n: int, low: int = 0, high: int = 100) -> str:
    expr = f"CAST(least(greatest(floor(({axis} - CAST({low} AS DOUBLE)) / CAST({high - low} AS DOUBLE) * CAST({n} AS DOUBLE)), 0), {n - 1}) AS INTEGER)"
    return f"SELECT point_id, {expr} AS {name} FROM (SELECT point_id, x - 10 AS x, y + 10 AS y FROM ({X.points_sql('orders')}))"


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.points(spark, sf_dir, "orders").select("point_id", (F.col("x") - 10).alias("x"), (F.col("y") + 10).alias("y"))  # some lie outside the domain


register("stripe_of_point", lambda s, d: _moved(s, d).select("point_id", C.stripe_of(F.col("x"), 0.0, 100.0, 4).alias("stripe")), _slot_sql("stripe", "x", 4))
register("strip_of_point", lambda s, d: _moved(s, d).select("point_id", C.strip_of(F.col("y"), 0.0, 100.0, 10).alias("strip")), _slot_sql("strip", "y", 10))


def _spread_sql(v: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = f"((({v}) | (({v}) << {shift})) & {mask})"
    return v


_AXIS = "CAST(least(greatest(floor({a} / CAST(100 AS DOUBLE) * CAST(65536 AS DOUBLE)), 0), 65535) AS BIGINT)"
MORTON_SQL = f"""WITH i AS (SELECT point_id, {_AXIS.format(a="x")} AS ix, {_AXIS.format(a="y")} AS iy FROM ({X.points_sql("orders")}))
SELECT point_id, {_spread_sql("ix")} | ({_spread_sql("iy")} << 1) AS morton FROM i"""
register("morton_code", lambda s, d: X.points(s, d, "orders").select("point_id", C.morton(F.col("x"), F.col("y"), (0.0, 0.0, 100.0, 100.0)).alias("morton")), MORTON_SQL)
register(
    "morton_tiles",
    lambda s, d: order.tile_of(X.points(s, d, "orders"), D, 24).groupBy("tile").agg(F.count("*").alias("points")),
    f"SELECT morton >> 24 AS tile, count(*) AS points FROM ({MORTON_SQL}) GROUP BY 1",
)
register("morton_sorted", lambda s, d: order.morton_sorted(X.points(s, d, "orders"), D), X.points_sql("orders"))
register(
    "splitmix64",
    lambda s, d: with_mixed(X.points(s, d, "orders").select("point_id"), F.col("point_id"), "m").select("point_id", hex64(F.col("m")).alias("h")),
    f"SELECT k AS point_id, lower(to_hex(h)) AS h FROM ({O.mixed('o_orderkey', 'SELECT o_orderkey, CAST(o_orderkey AS UBIGINT) AS v FROM orders')})",
)
register("quadtree_leaves", lambda s, d: quadtree.leaves(J.prepared(generate.grid(s, 10, 10)), D).select("depth", "cx", "cy", "n"))
register(
    "quadtree_covers_root",
    lambda s, d: quadtree.leaves(J.prepared(generate.grid(s, 10, 10)), D).agg(F.sum(F.pow(F.lit(0.25), F.col("depth"))).alias("share")),
    "SELECT CAST(1 AS DOUBLE) AS share",
)
register("uniform_points_rand", lambda s, d: generate.uniform(s, 10_000))
register("clustered_points_randn", lambda s, d: generate.clustered(s, 10_000))
register("real_bounds_points", lambda s, d: generate.clustered(s, 10_000, generate.REAL_BOUNDS))
register(
    "generated_points_in_domain",
    lambda s, d: generate.uniform(s, 10_000).unionByName(generate.clustered(s, 10_000)).agg(F.count("*").alias("points"), F.count_if(F.col("x").between(0, 100) & F.col("y").between(0, 100)).alias("inside")),
    "SELECT CAST(20000 AS BIGINT) AS points, CAST(20000 AS BIGINT) AS inside",
)
register(
    "batched_generation",
    lambda s, d: generate.batched(X.points(s, d, "orders"), 1000).groupBy("batch_id", "batch_seed").agg(F.count("*").alias("points")),
    "SELECT o_orderkey // 1000 AS batch_id, 42 + (o_orderkey // 1000) * 104729 AS batch_seed, count(*) AS points FROM orders GROUP BY ALL",
)


# Checks, schedules and streams.
def _verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, grid = X.points(spark, sf_dir, "events"), generate.grid(spark, 10, 10)
    return verify.agreement({s: J.classify(points, grid, strategy=s) for s in J.STRATEGIES}, "brute")


register("verify_strategies", _verify, "SELECT * FROM (VALUES " + ", ".join(f"('{s}', CAST(0 AS BIGINT))" for s in J.STRATEGIES if s != "brute") + ") v(strategy, mismatches)")
register(
    "verify_symmetric_difference",
    lambda s, d: verify.symmetric_difference(_pip_grid(s, d, "cells"), _pip_grid(s, d, "strip")).agg(F.count("*").alias("rows")),
    "SELECT CAST(0 AS BIGINT) AS rows",
)


def _scheduled(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return A.summary(J.classify(order.scheduled(X.points(spark, sf_dir, "events"), kind), generate.grid(spark, 10, 10)))


for _kind in order.SCHEDULES:
    register(f"schedule_{_kind}", partial(_scheduled, kind=_kind), SUMMARY_SQL)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = X.POINTS_SQL["events"].rpartition("FROM events")[0]
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="stream-")
    to_points = lambda batch: batch.sparkSession.sql(f"{text} FROM {{t}}", t=batch)
    return summarise_files(spark, f"{sf_dir}/events.parque[t]", events.schema, to_points, generate.grid(spark, 10, 10), folder)


register("batched_stream_summary", _stream, SUMMARY_SQL)
register(
    "merge_stripes",
    lambda s, d: A.merged(A.partials(_classified(s, d, "events").withColumn("stripe", C.stripe_of(F.col("x"), 0.0, 100.0, 4)), "stripe")),
    SUMMARY_SQL,
)

# GeoJSON and binary interchange.
MINI = """{"type": "FeatureCollection", "features": [
 {"type": "Feature", "properties": {"x_coord": "66.5", "y_coord": "25.25"}, "geometry": {"type": "Polygon", "coordinates": [[[66,25],[67,25],[67,26],[66,26],[66,25]],[[66.2,25.2],[66.4,25.2],[66.4,25.4],[66.2,25.2]]]}},
 {"type": "Feature", "properties": {"x_coord": 70.5, "y_coord": 30}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[70,30],[71,30],[71,31],[70,30]]],[[[72,32],[73,32],[73,33],[72,33],[72,32]]]]}},
 {"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [68.125, 27.5]}}]}"""


def _mini(spark: SparkSession) -> DataFrame:
    return geojson.from_text(spark.createDataFrame([(MINI,)], "json string"))


register(
    "geojson_polygons",
    lambda s, d: geojson.polygons(_mini(s)).select("polygon_id", "part_no", F.size("exterior").cast("bigint").alias("vertices"), F.size("holes").cast("bigint").alias("holes"), *G.bounds(F.col("exterior"))),
    """SELECT CAST(a AS BIGINT) AS polygon_id, CAST(b AS INTEGER) AS part_no, CAST(c AS BIGINT) AS vertices, CAST(d AS BIGINT) AS holes, CAST(e AS DOUBLE) AS min_x, CAST(f AS DOUBLE) AS min_y, CAST(g AS DOUBLE) AS max_x, CAST(h AS DOUBLE) AS max_y
FROM (VALUES (0, 0, 4, 1, 66, 25, 67, 26), (1, 0, 3, 0, 70, 30, 71, 31), (1, 1, 4, 0, 72, 32, 73, 33)) v(a, b, c, d, e, f, g, h)""",
)
register(
    "geojson_flattened",
    lambda s, d: geojson.polygons(_mini(s), flatten=True).select("polygon_id", "part_no"),
    "SELECT CAST(a AS BIGINT) AS polygon_id, CAST(0 AS INTEGER) AS part_no FROM (VALUES (0), (1048576), (1048577)) v(a)",
)
register(
    "geojson_centroids",
    lambda s, d: geojson.centroids(_mini(s)),
    "SELECT CAST(a AS BIGINT) AS point_id, CAST(b AS DOUBLE) AS x, CAST(c AS DOUBLE) AS y FROM (VALUES (0, 66.5, 25.25), (1, 70.5, 30), (2, 68.125, 27.5)) v(a, b, c)",
)


def _binary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = X.points(spark, sf_dir, "orders").withColumn("stripe", C.stripe_of(F.col("x"), 0.0, 100.0, 4))
    return binary.decode_points(binary.encode_points(own, "stripe", (0.0, 100.0), chunk=1000))


def _binary_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = A.per_stripe(_classified(spark, sf_dir, "events"), D, 4).withColumn("candidates", F.col("points"))
    return binary.decode_results(binary.encode_results(own)).select("stripe", "points", "matched", "unmatched", "checksum")


register("binary_points_round_trip", _binary_points, X.points_sql("orders"))
register("binary_polygons_round_trip", lambda s, d: binary.decode_polygons(binary.encode_polygons(generate.grid(s, 10, 10))).select("polygon_id", *G.bounds(F.col("exterior"))), O.grid_sql())
register("binary_results_round_trip", _binary_results, O.summary_sql(O.grid_classified("events"), O.STRIPE))
register(
    "parse_size_list",
    lambda s, d: s.createDataFrame([("100,,250000, 7",)], "text string").select(F.explode(F.filter(F.split("text", ","), lambda v: F.trim(v) != "")).alias("v")).select(F.trim("v").cast("bigint").alias("size")),
    "SELECT CAST(v AS BIGINT) AS size FROM (VALUES (100), (250000), (7)) t(v)",
)


def _scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("strong", 1, 800.0), ("strong", 2, 500.0), ("strong", 4, 400.0), ("weak", 1, 200.0), ("weak", 2, 250.0)]
    return A.speedup(spark.createDataFrame(rows, "experiment string, workers int, ms double"))


register(
    "scaling_speedup",
    _scaling,
    """SELECT e AS experiment, CAST(w AS INTEGER) AS workers, CAST(m AS DOUBLE) AS ms, CAST(o AS DOUBLE) / CAST(m AS DOUBLE) AS speedup, CAST(o AS DOUBLE) / CAST(m AS DOUBLE) / CAST(w AS DOUBLE) AS efficiency
FROM (VALUES ('strong', 1, 800, 800), ('strong', 2, 500, 800), ('strong', 4, 400, 800), ('weak', 1, 200, 200), ('weak', 2, 250, 200)) v(e, w, m, o)""",
)
register("median_of_runs", lambda s, d: _scaling(s, d).groupBy("experiment").agg(F.median("ms").alias("ms")), "SELECT * FROM (VALUES ('strong', CAST(500 AS DOUBLE)), ('weak', CAST(225 AS DOUBLE))) v(experiment, ms)")

__all__ = ["ORACLE", "POINTS", "QUERIES", "Domain"]
