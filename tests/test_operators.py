import pytest
from pyspark.sql import functions as F

from tessera.model import POINTS, Domain, polygons
from tessera.operators import aggregate, join, order, quadtree, verify
from tessera.plans import fixtures
from tessera.sources import binary, generate, geojson, tables


def test_plan_of_cells_shuffles_no_points(spark, sf_dir):
    out = join.classify(fixtures.points(spark, sf_dir, "orders"), generate.grid(spark, 10, 10))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan or "strategy=broadcast" in plan


def test_crowded_cells_fall_back(spark, monkeypatch):
    monkeypatch.setattr(join, "GATHERED", 2)
    points = generate.uniform(spark, 200)
    rows = polygons(spark, [(i, 0, [(0, 0), (100, 0), (100, 100), (0, 100)], []) for i in range(5)])
    assert {r.polygon_id for r in join.classify(points, rows).collect()} == {0}


def test_large_polygon_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(join, "BROADCAST", 0)
    points, grid = generate.uniform(spark, 500), generate.grid(spark, 10, 10)
    for strategy in ("cells", "strip", "replicated", "quadtree"):
        out = join.classify(points, grid, strategy)
        assert "strategy=broadcast" not in out._jdf.queryExecution().optimizedPlan().toString()
        assert out.where("polygon_id is null").count() == 0


def test_quadtree_builds_alike_on_driver_and_cluster(spark, monkeypatch):
    parts = join.prepared(generate.grid(spark, 12, 7))
    d = join.extent(parts).domain
    rows = lambda df: sorted((r.depth, r.cx, r.cy, r.n, tuple(sorted(map(tuple, r.ids)))) for r in df.collect())
    one = rows(quadtree.leaves(parts, d))
    monkeypatch.setattr(quadtree, "ON_DRIVER", 0)
    assert rows(quadtree.leaves(parts, d)) == one


@pytest.mark.parametrize(("leaf", "depth"), [(1, 3), (7, 8), (100, 0)])
def test_quadtree_parameters_do_not_change_results(spark, leaf, depth, monkeypatch):
    monkeypatch.setattr(quadtree.directory, "__defaults__", (leaf, depth))
    points, grid = generate.uniform(spark, 300), generate.grid(spark, 10, 10)
    assert verify.differences(join.classify(points, grid, "quadtree"), join.classify(points, grid, "brute")).count() == 0


def test_shard_copies_of_the_large_grid(spark):
    rows = aggregate.shard_copies(generate.grid(spark, 100, 100), Domain(), 4).orderBy("stripe").collect()
    assert [r.polygons for r in rows] == [2600, 2700, 2700, 2600]


def test_invariants(spark):
    points = generate.clustered(spark, 2000)
    row = aggregate.summary(join.classify(points, fixtures.shapes(spark))).first()
    assert row.matched + row.unmatched == row.points == 2000
    striped = aggregate.per_stripe(join.classify(points, fixtures.shapes(spark)), Domain(), 4)
    assert striped.agg(F.sum("points")).first()[0] == 2000


def test_empty_summary(spark):
    row = aggregate.summary(join.classify(generate.uniform(spark, 0), fixtures.shapes(spark))).first()
    assert (row.points, row.matched, row.unmatched, row.checksum) == (0, 0, 0, "0")


def test_morton_order_within_partitions(spark):
    parts = order.morton_sorted(generate.uniform(spark, 1000), Domain(), 3)
    z = order._z(parts, Domain()).withColumn("p", F.spark_partition_id())
    by = {}
    for r in z.select("p", "_z").collect():
        by.setdefault(r.p, []).append(r._z)
    assert all(v == sorted(v) for v in by.values())
    ends = sorted((min(v), max(v)) for v in by.values())
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_unknown_names_are_errors(spark):
    points = generate.uniform(spark, 1)
    with pytest.raises(ValueError, match="unknown strategy"):
        join.classify(points, fixtures.shapes(spark), "other")
    with pytest.raises(ValueError, match="unknown schedule"):
        order.scheduled(points, "other")


def test_generators_repeat_and_stay_in_bounds(spark):
    for make in (generate.uniform, generate.clustered):
        a, b = (make(spark, 500, generate.REAL_BOUNDS) for _ in range(2))
        assert verify.symmetric_difference(a, b).count() == 0
        d = generate.REAL_BOUNDS
        assert a.where(F.col("x").between(d.min_x, d.max_x) & F.col("y").between(d.min_y, d.max_y)).count() == 500


def test_geojson_file_and_fallback(spark, tmp_path):
    from tessera.plans.queries import MINI

    file = tmp_path / "admin2.geojson"
    file.write_text(MINI)
    feats = geojson.read(spark, str(tmp_path / "admin3.geojson"), str(file))
    assert geojson.polygons(feats).count() == 3
    assert geojson.centroids(feats).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        geojson.read(spark, str(tmp_path / "none.geojson"))


def test_binary_files(spark, tmp_path):
    own = generate.uniform(spark, 100).withColumn("stripe", F.lit(2))
    payload = binary.encode_points(own.coalesce(1), "stripe", (0.0, 100.0)).first().payload
    (tmp_path / "points.bin").write_bytes(payload)
    back = binary.decode_points(binary.read_files(spark, str(tmp_path / "points.bin")))
    assert verify.symmetric_difference(back, own.drop("stripe")).count() == 0
    (tmp_path / "points.bin").write_bytes(payload[:-8])
    with pytest.raises(Exception, match="buffer is smaller"):
        binary.decode_points(binary.read_files(spark, str(tmp_path / "points.bin"))).collect()


def test_polygons_with_holes_survive_binary(spark):
    back = binary.decode_polygons(binary.encode_polygons(fixtures.nations(spark)))
    assert verify.symmetric_difference(back, fixtures.nations(spark)).count() == 0


def test_partitioned_sink(spark, tmp_path):
    points = generate.uniform(spark, 400)
    tables.write_by_stripe(points, str(tmp_path / "p"), Domain(), 4)
    assert tables.read_stripes(spark, str(tmp_path / "p")).count() == 400
    one = tables.read_stripes(spark, str(tmp_path / "p"), 2)
    assert one.count() == points.where("x >= 50 and x < 75").count()


@pytest.mark.parametrize("strategy", join.STRATEGIES)
@pytest.mark.parametrize("gathered", [64, 0])
def test_each_row_of_points_comes_back_once(spark, monkeypatch, strategy, gathered):
    """Repeated rows and columns that can't be grouped by, at any crowding."""
    monkeypatch.setattr(join, "GATHERED", gathered)
    rows = [(1, 8.0, 8.0, {"a": 1}), (1, 8.0, 8.0, {"a": 1}), (1, 8.0, 8.0, {"a": 1}), (2, 99.0, 99.0, None), (3, None, 4.0, {"b": 2})]
    points = spark.createDataFrame(rows, POINTS + ", `x.y z` map<string,int>")
    out = join.classify(points, fixtures.shapes(spark), strategy)
    assert out.columns == [*points.columns, "polygon_id", "cls"]
    got = sorted(((r[0], r[4], r[3]) for r in out.collect()), key=str)
    assert got == [(1, 1, {"a": 1})] * 3 + [(2, None, None), (3, None, {"b": 2})]


def test_crowding_changes_no_row(spark, monkeypatch):
    """Polygons over the same place, on both sides of the bound and far beyond it."""
    points = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 50.0, 50.0)], POINTS)
    for n in (64, 65, 1100):
        rows = polygons(spark, [(i, 0, [(0, 0), (10, 0), (10, 10), (0, 10)], []) for i in range(n)])
        assert sorted((r.point_id, r.polygon_id, r.cls) for r in join.classify(points, rows).collect()) == [(1, 0, "INSIDE"), (1, 0, "INSIDE"), (2, None, "OUTSIDE")]


def test_repeated_points_and_extra_columns(spark):
    points = spark.createDataFrame([(1, 8.0, 8.0, "a"), (1, 8.0, 8.0, "a"), (2, 99.0, 99.0, "b")], POINTS + ", near string")
    rows = join.classify(points, fixtures.shapes(spark)).collect()
    assert sorted((r.point_id, r.polygon_id, r.near) for r in rows if r.polygon_id) == [(1, 1, "a"), (1, 1, "a")]


def test_fullest_breaks_ties_by_id_and_skips_the_unmatched(spark):
    rows = [(2,), (2,), (1,), (1,), (3,), (None,), (None,), (None,)]
    found = spark.createDataFrame(rows, "polygon_id bigint")
    assert [tuple(r) for r in aggregate.fullest(found, 2).collect()] == [(1, 2), (2, 2)]
    assert aggregate.fullest(found, 9).count() == 3
    assert aggregate.fullest(found.limit(0), 2).count() == 0
