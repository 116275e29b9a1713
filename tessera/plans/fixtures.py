"""Points from the driver's tables and small polygon sets, as data for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.model import Domain, polygons

DOMAIN = Domain()


def _unit_sum(key: str, primes: tuple[int, int, int], moduli: tuple[int, int, int]) -> str:
    terms = [f"CAST(({key} * {p}) % {m} AS DOUBLE) / CAST({m} AS DOUBLE)" for p, m in zip(primes, moduli, strict=True)]
    return f"({' + '.join(terms)} - CAST(1.5 AS DOUBLE)) * CAST(3 AS DOUBLE)"


def _centre(values: tuple[int, ...]) -> str:
    return "CAST(CASE user_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END AS DOUBLE)"


#: SQL of point views, the same for Spark and DuckDB but for array indices.
POINTS_SQL = {
    "orders": """SELECT o_orderkey AS point_id,
  CAST((o_orderkey * 7919 + 13) % 100003 AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(100003 AS DOUBLE) AS x,
  CAST((o_orderkey * 104729 + 71) % 99991 AS DOUBLE) * CAST(100 AS DOUBLE) / CAST(99991 AS DOUBLE) AS y
FROM orders""",
    "events": f"""SELECT event_id AS point_id,
  {_centre((20, 45, 50, 75, 88))} + {_unit_sum("event_id", (7919, 104729, 1299709), (1009, 1013, 1019))} AS x,
  {_centre((30, 50, 80, 25, 70))} + {_unit_sum("event_id", (15485863, 32452843, 49979687), (1021, 1031, 1033))} AS y
FROM events""",
    "customer": """SELECT c_custkey AS point_id, (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE) AS x,
  CAST(c_nationkey * 4 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS y FROM customer""",
    "embeddings": """SELECT vec_id AS point_id, CAST(50 AS DOUBLE) + CAST(100 AS DOUBLE) * CAST(embedding[{first}] AS DOUBLE) AS x,
  CAST(50 AS DOUBLE) + CAST(100 AS DOUBLE) * CAST(embedding[{second}] AS DOUBLE) AS y FROM embeddings""",
    "part": """SELECT p_partkey AS point_id, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 50 AS DOUBLE) AS y FROM part""",
}


def points_sql(table: str) -> str:
    """A point view in DuckDB's SQL."""
    return POINTS_SQL[table].format(first=1, second=2)


def points(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A point view over a driver's table."""
    text = POINTS_SQL[table].format(first=0, second=1)
    select, _, _ = text.rpartition(f"FROM {table}")
    return spark.sql(f"{select} FROM {{t}}", t=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


#: (polygon_id, part_no, exterior, holes): concave, holed, multipart, triangle, overlapping and notched shapes.
SHAPES: list[tuple[int, int, list, list]] = [
    (1, 0, [(5, 5), (25, 5), (25, 12), (12, 12), (12, 30), (5, 30)], []),
    (2, 0, [(35, 35), (65, 35), (65, 65), (35, 65)], [[(45, 45), (55, 45), (55, 55), (45, 55)]]),
    (3, 0, [(70, 5), (80, 5), (80, 15), (70, 15)], []),
    (3, 1, [(85, 20), (95, 20), (95, 30), (85, 30)], []),
    (4, 0, [(10, 60), (30, 60), (20, 90)], []),
    (5, 0, [(60, 60), (80, 60), (80, 80), (60, 80)], []),
    (6, 0, [(70, 38), (95, 38), (95, 52), (82, 42), (70, 52)], []),
]


def nation_shapes() -> list[tuple[int, int, list, list]]:
    """A square of side 20 for each of 25 nations; even ones have a central hole of side 4."""
    out = []
    for n in range(25):
        x, y = 20 * (n % 5), 20 * (n // 5)
        hole = [(x + 8, y + 8), (x + 12, y + 8), (x + 12, y + 12), (x + 8, y + 12)]
        out.append((n, 0, [(x, y), (x + 20, y), (x + 20, y + 20), (x, y + 20)], [hole] if n % 2 == 0 else []))
    return out


def shapes(spark: SparkSession) -> DataFrame:
    """SHAPES as polygons."""
    return polygons(spark, SHAPES)


def nations(spark: SparkSession) -> DataFrame:
    """Nation squares as polygons."""
    return polygons(spark, nation_shapes())


def edges_sql(rows: list[tuple[int, int, list, list]]) -> str:
    """VALUES rows (polygon_id, part_no, ring_no, ax, ay, bx, by); ring 0 is the exterior."""
    values = []
    for i, p, exterior, holes in rows:
        for r, ring in enumerate([exterior, *holes]):
            values += [f"({i}, {p}, {r}, {float(a[0])}, {float(a[1])}, {float(b[0])}, {float(b[1])})" for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return ",\n  ".join(values)
