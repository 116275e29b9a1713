"""Geometry on columns.

A ring is ``array<struct<x,y>>`` without its closing vertex; its edges are
``array<struct<ax,ay,bx,by>>``, made once for each polygon so that a test per
point only walks them.  All tests are built-in expressions; no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Absolute tolerance of the collinearity and horizontal-edge tests (a fixed value).
EPSILON = 1e-10

VERTEX = "struct<x:double,y:double>"
EDGE = "struct<ax:double,ay:double,bx:double,by:double>"

INSIDE, OUTSIDE, ON_BOUNDARY = "INSIDE", "OUTSIDE", "ON_BOUNDARY"
#: Boundary modes: every edge counts, or horizontal edges are skipped before the on-segment test.
INCLUSIVE, DOCUMENTED = "inclusive", "documented"


def open_ring(ring: Column) -> Column:
    """The ring without a last vertex that repeats the first."""
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(closed, F.slice(ring, 1, F.size(ring) - 1)).otherwise(ring)


def edges(ring: Column) -> Column:
    """Edges of an open ring; none for fewer than three vertices."""
    rotated = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    paired = F.zip_with(ring, rotated, lambda a, b: F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by")))
    return F.when(F.size(ring) >= 3, paired).otherwise(F.array().cast(f"array<{EDGE}>"))


def on_segment(e: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on an edge, within EPSILON of collinear."""
    cross = (e.bx - e.ax) * (y - e.ay) - (e.by - e.ay) * (x - e.ax)
    return (F.abs(cross) < EPSILON) & x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by))


def is_horizontal(e: Column) -> Column:
    """Whether an edge's ends are level within EPSILON."""
    return F.abs(e.ay - e.by) < EPSILON


def crosses(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from the point towards rising x crosses an edge; the guard rules out division by zero."""
    straddles = ~is_horizontal(e) & ((e.ay > y) != (e.by > y))
    return F.when(straddles, e.ax + (y - e.ay) / (e.by - e.ay) * (e.bx - e.ax) > x).otherwise(F.lit(False))


def ring_class(ring_edges: Column, x: Column, y: Column, boundary: str = INCLUSIVE) -> Column:
    """INSIDE, OUTSIDE or ON_BOUNDARY of one ring, by the even-odd rule."""
    counts = (lambda e: on_segment(e, x, y)) if boundary == INCLUSIVE else (lambda e: ~is_horizontal(e) & on_segment(e, x, y))
    odd = F.size(F.filter(ring_edges, lambda e: crosses(e, x, y))) % 2 == 1
    return F.when(F.exists(ring_edges, counts), ON_BOUNDARY).when(odd, INSIDE).otherwise(OUTSIDE)


def polygon_class(exterior: Column, holes: Column, x: Column, y: Column, boundary: str = INCLUSIVE) -> Column:
    """Class of a polygon with holes; a hole's boundary belongs to the polygon's."""
    outer = ring_class(exterior, x, y, boundary)
    on_hole = F.exists(holes, lambda h: ring_class(h, x, y, boundary) == ON_BOUNDARY)
    in_hole = F.exists(holes, lambda h: ring_class(h, x, y, boundary) == INSIDE)
    return F.when(outer != INSIDE, outer).when(on_hole, ON_BOUNDARY).when(in_hole, OUTSIDE).otherwise(INSIDE)


def box_class(min_x: Column, min_y: Column, max_x: Column, max_y: Column, x: Column, y: Column, boundary: str = INCLUSIVE) -> Column:
    """Class of an axis-aligned rectangle without walking its edges."""
    side = (x == min_x) | (x == max_x)
    level = (y == min_y) | (y == max_y)
    inside = x.between(min_x, max_x) & y.between(min_y, max_y)
    if boundary == INCLUSIVE:
        return F.when(~inside, OUTSIDE).when(side | level, ON_BOUNDARY).otherwise(INSIDE)
    return F.when(~inside, OUTSIDE).when(side, ON_BOUNDARY).when(y == max_y, OUTSIDE).otherwise(INSIDE)


def bounds(ring: Column) -> list[Column]:
    """min_x, min_y, max_x and max_y of a ring."""
    xs, ys = F.transform(ring, lambda v: v.x), F.transform(ring, lambda v: v.y)
    return [F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y")]


def is_box(ring: Column) -> Column:
    """Whether an open ring is an axis-aligned rectangle with area, walked along its sides."""
    x = lambda i: F.element_at(ring, i).x
    y = lambda i: F.element_at(ring, i).y
    flat_first = (y(1) == y(2)) & (x(2) == x(3)) & (y(3) == y(4)) & (x(4) == x(1))
    tall_first = (x(1) == x(2)) & (y(2) == y(3)) & (x(3) == x(4)) & (y(4) == y(1))
    return F.when(F.size(ring) == 4, (flat_first | tall_first) & (x(1) != x(3)) & (y(1) != y(3))).otherwise(F.lit(False))


def add_hole(holes: Column, ring: Column) -> Column:
    """Holes with one more inner ring."""
    return F.array_append(F.coalesce(holes, F.array().cast(f"array<array<{VERTEX}>>")), ring)


def finite(x: Column, y: Column) -> Column:
    """Whether both coordinates are numbers; NaN would sort above every bound."""
    return x.isNotNull() & y.isNotNull() & ~F.isnan(x) & ~F.isnan(y)
