"""Cells: stripes along x, strips along y, grid cells, quadtree cells and Morton codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot(v: Column, low: float, high: float, n: int) -> Column:
    """Which of n equal intervals a value lies in, clamped to the first and last; rises with the value, and NaN is in the last."""
    scaled = (v - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(float(n))
    return F.floor(F.least(F.greatest(scaled, F.lit(0.0)), F.lit(n - 1.0))).cast("int")


def stripe_of(x: Column, low: float, high: float, n: int) -> Column:
    """The stripe along x."""
    return slot(x, low, high, n)


def strip_of(y: Column, low: float, high: float, n: int) -> Column:
    """The strip along y."""
    return slot(y, low, high, n)


def stripe_bounds(stripe: Column, low: float, high: float, n: int) -> list[Column]:
    """A stripe's ends; the last ends exactly at the domain's end."""
    width = (float(high) - float(low)) / n
    start = F.lit(float(low)) + stripe * F.lit(width)
    return [start.alias("lo"), F.when(stripe == n - 1, F.lit(float(high))).otherwise(F.lit(float(low)) + (stripe + 1) * F.lit(width)).alias("hi")]


def meets_stripe(min_x: Column, max_x: Column, lo: Column, hi: Column) -> Column:
    """Whether closed bounds meet a stripe's closed ends."""
    return (max_x >= lo) & (min_x <= hi)


def _spread(v: Column) -> Column:
    """The low 16 bits of a long with a zero bit before each."""
    v = v.bitwiseAND(0xFFFF)
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(mask)
    return v


def interleave(ix: Column, iy: Column) -> Column:
    """Bits of two 16-bit numbers in turn, y's in the higher places."""
    return _spread(ix.cast("bigint")).bitwiseOR(F.shiftleft(_spread(iy.cast("bigint")), 1))


def morton(x: Column, y: Column, bounds: tuple[float, float, float, float]) -> Column:
    """Z-order code of a point with 16 bits for each axis."""
    x0, y0, x1, y1 = bounds
    return interleave(slot(x, x0, x1, 65536), slot(y, y0, y1, 65536))
