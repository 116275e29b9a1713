"""SQL of the registered queries for DuckDB: brute force on bounds and edges, without cells or indexes."""

from __future__ import annotations

from tessera.plans.fixtures import edges_sql, points_sql


def grid_sql(n: int = 10) -> str:
    """Cells of an n x n grid over [0, 100] with their bounds."""
    side = f"CAST({100 / n} AS DOUBLE)"
    return f"""SELECT CAST(i AS BIGINT) AS polygon_id,
    CAST(i % {n} AS DOUBLE) * {side} AS min_x, CAST(i // {n} AS DOUBLE) * {side} AS min_y,
    CAST(i % {n} + 1 AS DOUBLE) * {side} AS max_x, CAST(i // {n} + 1 AS DOUBLE) * {side} AS max_y
  FROM range({n * n}) t(i)"""


def grid_classified(table: str, n: int = 10) -> str:
    """CTEs ending in classified (point_id, x, y, polygon_id, cls) for a grid."""
    return f"""p AS ({points_sql(table)}),
g AS ({grid_sql(n)}),
best AS (
  SELECT p.point_id, min(g.polygon_id) AS polygon_id FROM p JOIN g
    ON p.x BETWEEN g.min_x AND g.max_x AND p.y BETWEEN g.min_y AND g.max_y GROUP BY p.point_id),
classified AS (
  SELECT p.point_id, p.x, p.y, best.polygon_id,
    CASE WHEN best.polygon_id IS NULL THEN 'OUTSIDE'
      WHEN p.x = g.min_x OR p.x = g.max_x OR p.y = g.min_y OR p.y = g.max_y THEN 'ON_BOUNDARY' ELSE 'INSIDE' END AS cls
  FROM p LEFT JOIN best ON p.point_id = best.point_id LEFT JOIN g ON g.polygon_id = best.polygon_id)"""


def shapes_classified(table: str, rows: list, boundary: str = "inclusive") -> str:
    """CTEs ending in classified for polygons given by their edges."""
    counted = "TRUE" if boundary == "inclusive" else "abs(e.ay - e.by) >= 1e-10"
    return f"""p AS ({points_sql(table)}),
e(polygon_id, part_no, ring_no, ax, ay, bx, by_) AS (
  SELECT CAST(c0 AS BIGINT), CAST(c1 AS INTEGER), CAST(c2 AS INTEGER), CAST(c3 AS DOUBLE), CAST(c4 AS DOUBLE), CAST(c5 AS DOUBLE), CAST(c6 AS DOUBLE)
  FROM (VALUES
  {edges_sql(rows)}) v(c0, c1, c2, c3, c4, c5, c6)),
rings AS (
  SELECT p.point_id, e.polygon_id, e.part_no, e.ring_no,
    bool_or({counted.replace("e.by", "e.by_")} AND abs((e.bx - e.ax) * (p.y - e.ay) - (e.by_ - e.ay) * (p.x - e.ax)) < 1e-10
      AND p.x BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND p.y BETWEEN least(e.ay, e.by_) AND greatest(e.ay, e.by_)) AS on_edge,
    count(*) FILTER (WHERE abs(e.ay - e.by_) >= 1e-10 AND (e.ay > p.y) <> (e.by_ > p.y)
      AND CASE WHEN (e.ay > p.y) <> (e.by_ > p.y) THEN e.ax + (p.y - e.ay) / (e.by_ - e.ay) * (e.bx - e.ax) > p.x ELSE FALSE END) % 2 = 1 AS odd
  FROM p CROSS JOIN e GROUP BY ALL),
parts AS (
  SELECT point_id, polygon_id, part_no,
    bool_or(ring_no = 0 AND on_edge) AS outer_on, bool_or(ring_no = 0 AND odd) AS outer_odd,
    bool_or(ring_no > 0 AND on_edge) AS hole_on, bool_or(ring_no > 0 AND odd AND NOT on_edge) AS hole_odd
  FROM rings GROUP BY ALL),
classes AS (
  SELECT point_id, polygon_id, part_no,
    CASE WHEN outer_on THEN 'ON_BOUNDARY' WHEN NOT outer_odd THEN 'OUTSIDE' WHEN hole_on THEN 'ON_BOUNDARY' WHEN hole_odd THEN 'OUTSIDE' ELSE 'INSIDE' END AS cls
  FROM parts),
best AS (
  SELECT point_id, min({{'polygon_id': polygon_id, 'part_no': part_no, 'cls': cls}}) AS hit FROM classes WHERE cls <> 'OUTSIDE' GROUP BY point_id),
classified AS (
  SELECT p.point_id, p.x, p.y, hit.polygon_id AS polygon_id, coalesce(hit.cls, 'OUTSIDE') AS cls
  FROM p LEFT JOIN best ON p.point_id = best.point_id)"""


def _wrapped(a: str, c: str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({c} AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT)"


def mixed(column: str, source: str) -> str:
    """A query (k, h) of splitmix64 over rows (k, v) with v UBIGINT."""
    return f"""SELECT k, xor(z3, z3 >> 31) AS h FROM (
    SELECT k, {_wrapped("xor(z2, z2 >> 27)", "10723151780598845931")} AS z3 FROM (
      SELECT k, {_wrapped("xor(z1, z1 >> 30)", "13787848793156543929")} AS z2 FROM (
        SELECT {column} AS k, CAST((CAST(v AS UHUGEINT) + CAST(11400714819323198485 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT) AS z1 FROM ({source}))))"""


#: Fingerprints of classified rows; no polygon counts as all ones.
PRINTS = """prints AS ({mix})""".format(
    mix=mixed("point_id", "SELECT point_id, xor(CAST((CAST(point_id AS UHUGEINT) * CAST(4294967296 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT) AS UBIGINT), coalesce(CAST(polygon_id AS UBIGINT), CAST(18446744073709551615 AS UBIGINT))) AS v FROM classified")
)

MEASURES = "count(*) AS points, count(c.polygon_id) AS matched, count(*) FILTER (WHERE c.polygon_id IS NULL) AS unmatched, lower(to_hex(bit_xor(f.h))) AS checksum"

STRIPE = "CAST(least(greatest(floor(c.x / CAST(100 AS DOUBLE) * CAST(4 AS DOUBLE)), 0), 3) AS INTEGER)"


def summary_sql(classified: str, by: str = "") -> str:
    """Counts and checksum, by an expression if given."""
    return f"WITH {classified},\n{PRINTS}\nSELECT {by + ' AS stripe, ' if by else ''}{MEASURES} FROM classified c JOIN prints f ON c.point_id = f.k{' GROUP BY 1' if by else ''}"

