import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions import geometry as G
from tessera.functions.fingerprint import hex64, with_mixed
from tessera.model import POINTS, polygons
from tessera.operators.join import STRATEGIES, classify
from tessera.plans import fixtures

# (x, y), polygon and class with all edges counted, and with horizontal edges skipped.
EXPECTED = [
    ((8, 8), (1, "INSIDE"), (1, "INSIDE")),
    ((20, 20), None, None),
    ((15, 12), (1, "ON_BOUNDARY"), None),
    ((12, 20), (1, "ON_BOUNDARY"), (1, "ON_BOUNDARY")),
    ((25, 12), (1, "ON_BOUNDARY"), (1, "ON_BOUNDARY")),
    ((40, 40), (2, "INSIDE"), (2, "INSIDE")),
    ((50, 50), None, None),
    ((45, 50), (2, "ON_BOUNDARY"), (2, "ON_BOUNDARY")),
    ((50, 45), (2, "ON_BOUNDARY"), None),
    ((50, 55), (2, "ON_BOUNDARY"), (2, "INSIDE")),
    ((65, 50), (2, "ON_BOUNDARY"), (2, "ON_BOUNDARY")),
    ((75, 10), (3, "INSIDE"), (3, "INSIDE")),
    ((82, 18), None, None),
    ((90, 25), (3, "INSIDE"), (3, "INSIDE")),
    ((20, 70), (4, "INSIDE"), (4, "INSIDE")),
    ((20, 60), (4, "ON_BOUNDARY"), (4, "INSIDE")),
    ((20, 90), (4, "ON_BOUNDARY"), (4, "ON_BOUNDARY")),
    ((62, 62), (2, "INSIDE"), (2, "INSIDE")),
    ((65, 65), (2, "ON_BOUNDARY"), (2, "ON_BOUNDARY")),
    ((82, 42), (6, "ON_BOUNDARY"), (6, "ON_BOUNDARY")),
    ((75, 42), (6, "INSIDE"), (6, "INSIDE")),
    ((82, 45), None, None),
    ((85, 42), (6, "INSIDE"), (6, "INSIDE")),
    ((99, 99), None, None),
]


@pytest.mark.parametrize("boundary", [G.INCLUSIVE, G.DOCUMENTED])
@pytest.mark.parametrize("strategy", STRATEGIES)
def test_expected_classes(spark, boundary, strategy):
    points = spark.createDataFrame([(i, float(x), float(y)) for i, ((x, y), *_) in enumerate(EXPECTED)], POINTS)
    got = {r.point_id: (r.polygon_id, r.cls) for r in classify(points, fixtures.shapes(spark), strategy, boundary).collect()}
    which = 1 if boundary == G.INCLUSIVE else 2
    assert got == {i: row[which] or (None, "OUTSIDE") for i, row in enumerate(EXPECTED)}


def test_unit_square_with_horizontal_edges_skipped(spark):
    square = polygons(spark, [(1, 0, [(0, 0), (1, 0), (1, 1), (0, 1)], [])])
    at = [(0, 0.5, 0.0), (1, 0.5, 1.0), (2, 0.0, 0.5), (3, 1.0, 0.5), (4, 0.0, 0.0), (5, 1.0, 0.0), (6, 1.0, 1.0), (7, 0.0, 1.0)]
    got = [r.cls for r in classify(spark.createDataFrame(at, POINTS), square, boundary=G.DOCUMENTED).orderBy("point_id").collect()]
    assert got == ["INSIDE", "OUTSIDE", *["ON_BOUNDARY"] * 6]


def _contains(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) < 1e-10 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if abs(ay - by) >= 1e-10 and (ay > y) != (by > y) and ax + (y - ay) / (by - ay) * (bx - ax) > x:
            odd = not odd
    return odd


def test_random_stars_against_a_model(spark):
    r = random.Random(5)
    stars = []
    for i in range(30):
        cx, cy, n = r.uniform(0, 100), r.uniform(0, 100), r.randint(3, 12)
        stars.append((i, 0, [(cx + s * math.cos(a), cy + s * math.sin(a)) for a, s in ((2 * math.pi * k / n, r.uniform(2, 20)) for k in range(n))], []))
    at = [(i, r.uniform(-10, 110), r.uniform(-10, 110)) for i in range(400)]
    want = {i: min((s[0] for s in stars if _contains(s[2], x, y)), default=None) for i, x, y in at}
    points = spark.createDataFrame(at, POINTS)
    for strategy in ("cells", "quadtree", "strip", "brute"):
        assert {p.point_id: p.polygon_id for p in classify(points, polygons(spark, stars), strategy).collect()} == want


def test_points_without_coordinates_and_empty_tables(spark):
    points = spark.createDataFrame([(1, None, 1.0), (2, float("nan"), 1.0), (3, 8.0, 8.0), (4, float("inf"), 8.0)], POINTS)
    for strategy in STRATEGIES:
        got = {r.point_id: r.polygon_id for r in classify(points, fixtures.shapes(spark), strategy).collect()}
        assert got == {1: None, 2: None, 3: 1, 4: None}, strategy
        assert classify(points.limit(0), fixtures.shapes(spark), strategy).count() == 0
        assert {r.polygon_id for r in classify(points, fixtures.shapes(spark).limit(0), strategy).collect()} == {None}


def test_closed_short_and_degenerate_rings(spark):
    rows = [(1, 0, [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], []), (2, 0, [(10, 10), (12, 12)], []), (3, 0, [(20, 20), (24, 20), (22, 24), (20, 20)], [])]
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 11.0, 11.0), (3, 22.0, 22.0)], POINTS)
    got = {r.point_id: r.polygon_id for r in classify(points, polygons(spark, rows)).collect()}
    assert got == {1: 1, 2: None, 3: 3}


def test_mixer_vectors(spark):
    rows = spark.createDataFrame([(0,), (1,), (-1,), (2**63 - 1,), (-(2**63),)], "v bigint")
    got = {r.v: r.h for r in with_mixed(rows, F.col("v"), "m").select("v", hex64(F.col("m")).alias("h")).collect()}

    def model(v):
        mask = (1 << 64) - 1
        z = (v + 0x9E3779B97F4A7C15) & mask
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
        return format(z ^ (z >> 31), "x")

    assert got == {v: model(v) for v in got}
    assert got[0] == "e220a8397b1dcdaf"
    assert got[1] == "910a2dec89025cc1"


def test_cells_are_clamped_and_monotone(spark):
    rows = spark.createDataFrame([(-5.0,), (0.0,), (24.9,), (25.0,), (99.9,), (100.0,), (1e300,)], "x double")
    assert [r.s for r in rows.select(C.stripe_of(F.col("x"), 0, 100, 4).alias("s")).collect()] == [0, 0, 0, 1, 3, 3, 3]


def test_morton_interleaves(spark):
    row = spark.range(1).select(C.interleave(F.lit(0b1011), F.lit(0b0110)).alias("z"), C.interleave(F.lit(65535), F.lit(65535)).alias("most")).first()
    assert row.z == 0b01101101
    assert row.most == 2**32 - 1
