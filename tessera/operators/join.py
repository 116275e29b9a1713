"""The spatial join: each point with the polygon that contains it.

``classify`` keeps every point and adds polygon_id (the smallest that contains
the point; null if none) and cls.  Every strategy deals polygons to keys, gathers
each key's candidates in one row, and lets points look their key up and test the
candidates in one projection.  One row in, one row out: points aren't exploded
or aggregated, and not shuffled if the polygons are within ``BROADCAST``.  All
strategies give the same rows:

* ``cells``: the key is a grid cell of about a polygon's size.
* ``brute``: one key for all.
* ``strip``: a strip along y.
* ``stripe``, ``replicated``, ``sharded``: a strip within a stripe along x; the
  polygons are sent to all tasks, or (``sharded``) dealt to the points' stripes
  by a shuffle.
* ``quadtree``: a cell of the directory of an adaptive quadtree's leaves.
* ``morton``: ``cells`` over points in Z-order.

Polygons go to all tasks only if their measured size is within ``BROADCAST``;
beyond that both sides are shuffled by key and Spark splits skewed keys.  If a
key has more than ``GATHERED`` candidates, points are numbered, joined with the
candidates row by row, and the first match of each number is taken: the same
rows, repeated points and all.  Points with null or NaN coordinates match nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import cells as C
from tessera.functions import geometry as G
from tessera.model import Domain, prepared
from tessera.operators import quadtree
from tessera.operators.order import morton_sorted

#: Bytes of prepared polygons up to which they go to all tasks.
BROADCAST = 64 << 20
#: Candidates of a cell up to which they are gathered in one row.
GATHERED = 64
#: Cells along an axis at most.
MOST_CELLS = 1024

STRATEGIES = ("cells", "brute", "strip", "stripe", "quadtree", "replicated", "sharded", "morton")


@dataclass(frozen=True)
class Extent:
    """What one aggregate over the polygons tells."""

    domain: Domain
    count: int
    width: float
    height: float
    bytes: int


def extent(parts: DataFrame) -> Extent:
    """Union of bounds, number of parts, mean sides and size of prepared polygons."""
    inner = F.aggregate("inner", F.lit(0), lambda n, h: n + F.size(h))
    row = parts.agg(
        F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y"), F.count("*"), F.avg(F.col("max_x") - F.col("min_x")), F.avg(F.col("max_y") - F.col("min_y")), F.sum(F.lit(128) + (F.size("outer") + inner) * 40)
    ).first()
    if not row[4]:
        return Extent(Domain(0.0, 0.0, 1.0, 1.0), 0, 1.0, 1.0, 0)
    x0, y0, x1, y1 = row[:4]
    return Extent(Domain(x0, y0, x1 if x1 > x0 else x0 + 1.0, y1 if y1 > y0 else y0 + 1.0), row[4], row[5], row[6], row[7])


def hinted(parts: DataFrame, size: int) -> DataFrame:
    """A broadcast hint if the size is within the bound."""
    return F.broadcast(parts) if size <= BROADCAST else parts


def exact(boundary: str, x: Column, y: Column, c: Column | None = None) -> Column:
    """Class of a point for a prepared part, given as columns or as a struct."""
    get = F.col if c is None else c.getField
    box = G.box_class(get("min_x"), get("min_y"), get("max_x"), get("max_y"), x, y, boundary)
    return F.when(get("box"), box).otherwise(G.polygon_class(get("outer"), get("inner"), x, y, boundary))


def in_bounds(x: Column, y: Column, c: Column | None = None) -> Column:
    """Closed test of the bounds."""
    get = F.col if c is None else c.getField
    return G.finite(x, y) & x.between(get("min_x"), get("max_x")) & y.between(get("min_y"), get("max_y"))


def spread(parts: DataFrame, name: str, axis: str, low: float, high: float, n: int) -> DataFrame:
    """One row for each interval that a part's closed bounds meet."""
    at = lambda side: C.slot(F.col(f"{side}_{axis}"), low, high, n)
    return parts.withColumn(name, F.explode(F.sequence(at("min"), at("max"))))


def _divisions(side: float, mean: float) -> int:
    return max(1, min(MOST_CELLS, round(side / mean) if mean > 0 else MOST_CELLS))


@dataclass(frozen=True)
class Dealt:
    """Parts by key: their table, the points' side of each key, and the table's size in bytes."""

    table: DataFrame
    keys: dict[str, Column]
    size: int
    shuffled: bool = False

    def hinted(self, table: DataFrame) -> DataFrame:
        """The table of polygons with the hint of how it meets the points."""
        return table.hint("shuffle_hash") if self.shuffled else hinted(table, self.size)


def _dealt(parts: DataFrame, e: Extent, strategy: str, n: int | None) -> Dealt:
    d, x, y = e.domain, F.col("x"), F.col("y")
    if strategy == "brute":
        return Dealt(parts.withColumn("_all", F.lit(0)), {"_all": F.lit(0)}, e.bytes)
    if strategy == "quadtree":
        table, keys = quadtree.directory(parts, d)
        return Dealt(table, keys, 4 * e.bytes)
    if strategy in ("cells", "morton"):
        nx, ny = _divisions(d.max_x - d.min_x, e.width), _divisions(d.max_y - d.min_y, e.height)
        table = spread(spread(parts, "_cx", "x", d.min_x, d.max_x, nx), "_cy", "y", d.min_y, d.max_y, ny)
        return Dealt(table, {"_cx": C.slot(x, d.min_x, d.max_x, nx), "_cy": C.slot(y, d.min_y, d.max_y, ny)}, 4 * e.bytes)
    strips = (n if strategy == "strip" else None) or _divisions(d.max_y - d.min_y, e.height)
    table, keys = spread(parts, "_strip", "y", d.min_y, d.max_y, strips), {"_strip": C.strip_of(y, d.min_y, d.max_y, strips)}
    if strategy != "strip":  # stripes deal the work; strips within them find the candidates
        keys["_stripe"] = C.stripe_of(x, d.min_x, d.max_x, n or 4)
        table = spread(table, "_stripe", "x", d.min_x, d.max_x, n or 4)
    return Dealt(table, keys, 2 * e.bytes, strategy == "sharded")


@dataclass(frozen=True)
class CellIndex:
    """Polygons by grid cell, made once for many point sets: rows of keys and near (candidates in order)."""

    domain: Domain
    dealt: Dealt
    boxes: bool
    gathered: DataFrame

    def release(self) -> None:
        """Frees the executors' copy."""
        self.gathered.unpersist()


def cell_index(polygons: DataFrame) -> CellIndex | None:
    """The index, or None if a cell has more than ``GATHERED`` candidates; ``release`` it when done."""
    parts = prepared(polygons)
    e = extent(parts)
    index = _gathered(_dealt(parts, e, "cells", None), e)
    return index and replace(index, gathered=index.gathered.persist())


def _gathered(dealt: Dealt, e: Extent) -> CellIndex | None:
    crowd = dealt.table.groupBy(*dealt.keys).agg(F.count("*").alias("n"), F.every("box").alias("boxes")).agg(F.max("n"), F.sum("n"), F.every("boxes")).first()
    if (crowd[0] or 0) > GATHERED:
        return None
    boxes = bool(crowd[2])
    fields = ("polygon_id", "part_no", "min_x", "min_y", "max_x", "max_y", *(() if boxes else ("box", "outer", "inner")))
    table = dealt.table.groupBy(*dealt.keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("near"))
    return CellIndex(e.domain, replace(dealt, size=int(e.bytes * (crowd[1] or 0) / max(1, e.count))), boxes, table)


def _look_up(points: DataFrame, index: CellIndex, boundary: str) -> DataFrame:
    """Each point with the first of its key's candidates that contains it."""
    x, y = F.col("x"), F.col("y")
    met = points.withColumns(index.dealt.keys).join(index.dealt.hinted(index.gathered), list(index.dealt.keys), "left")
    if index.boxes:
        cls = lambda c: G.box_class(c.min_x, c.min_y, c.max_x, c.max_y, x, y, boundary)
        holds = (lambda c: in_bounds(x, y, c)) if boundary == G.INCLUSIVE else (lambda c: in_bounds(x, y, c) & (cls(c) != G.OUTSIDE))
    else:
        cls = lambda c: exact(boundary, x, y, c)
        holds = lambda c: in_bounds(x, y, c) & (cls(c) != G.OUTSIDE)
    hit = met.select(*points.columns, F.get(F.filter("near", holds), F.lit(0)).alias("_hit"))
    found = F.when(F.col("_hit").isNotNull(), cls(F.col("_hit"))).otherwise(G.OUTSIDE)
    return hit.select(*points.columns, F.col("_hit.polygon_id").alias("polygon_id"), found.alias("cls"))


def candidates(points: DataFrame, polygons: DataFrame, strategy: str = "strip", n: int | None = None) -> DataFrame:
    """Rows of points with each part whose key and bounds fit; a point without one has nulls."""
    parts = prepared(polygons)
    return _candidates(points, _dealt(parts, extent(parts), strategy, n))


def _candidates(points: DataFrame, dealt: Dealt) -> DataFrame:
    right = dealt.hinted(dealt.table.withColumnsRenamed({k: f"{k}_of" for k in dealt.keys}))
    fits = in_bounds(F.col("x"), F.col("y"))
    for k in dealt.keys:
        fits = (F.col(k) == F.col(f"{k}_of")) & fits
    return points.withColumns(dealt.keys).join(right, fits, "left").drop(*dealt.keys, *(f"{k}_of" for k in dealt.keys))


def classify(points: DataFrame, polygons: DataFrame | CellIndex, strategy: str = "cells", boundary: str = G.INCLUSIVE, n: int | None = None) -> DataFrame:
    """Points with polygon_id and cls, which replace columns of these names.

    ``polygons`` may be a ``cell_index`` made before, for many point sets.

    Each row of points comes back once, repeated or not, with its other columns
    of any type and name.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    kept = [c for c in points.columns if c.lower() not in ("polygon_id", "cls")]
    own = points.select(*[F.col("`" + c.replace("`", "``") + "`").alias(c if c in ("point_id", "x", "y") else f"_own_{i}") for i, c in enumerate(kept)])
    if isinstance(polygons, CellIndex):
        if strategy not in ("cells", "morton"):
            raise ValueError("an index of cells serves the strategies cells and morton only")
        out = _look_up(morton_sorted(own, polygons.domain) if strategy == "morton" else own, polygons, boundary)
    else:
        out = _classify(own, prepared(polygons), strategy, boundary, n)
    return out.toDF(*kept, "polygon_id", "cls")


def _classify(points: DataFrame, parts: DataFrame, strategy: str, boundary: str, n: int | None) -> DataFrame:
    e = extent(parts)
    dealt = _dealt(parts, e, strategy, n)
    own = morton_sorted(points, e.domain) if strategy == "morton" else points
    if (index := _gathered(dealt, e)) is not None:
        return _look_up(own, index, boundary)
    x, y = F.col("x"), F.col("y")
    met = _candidates(own.withColumn("_row", F.monotonically_increasing_id()), dealt)
    cls = F.when(F.col("polygon_id").isNotNull(), exact(boundary, x, y))
    hit = F.when(cls != G.OUTSIDE, F.struct("polygon_id", "part_no", cls.alias("cls")))
    best = met.groupBy("_row").agg(F.min(hit).alias("_hit"), *[F.any_value(c).alias(c) for c in points.columns])
    return best.select(*points.columns, F.col("_hit.polygon_id").alias("polygon_id"), F.coalesce("_hit.cls", F.lit(G.OUTSIDE)).alias("cls"))


def points_in_any(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """Points that some polygon contains (semi join)."""
    return classify(points, polygons, **options).where("polygon_id is not null").select(*points.columns)


def points_in_none(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    """Points that no polygon contains (anti join)."""
    return classify(points, polygons, **options).where("polygon_id is null").select(*points.columns)
