"""A 64-bit mixer and row fingerprints that hold under ANSI arithmetic.

Spark's bigint throws on overflow in ANSI mode, so sums and products modulo
2**64 are put together from limbs that can't overflow; shifts never throw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the splitmix64 generator.
INCREMENT, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_LOW = 0xFFFFFFFF


def _parts(c: int) -> tuple[int, int, int, int]:
    return tuple((c >> k) & 0xFFFF for k in (0, 16, 32, 48))


def _multiplied(df: DataFrame, c: int) -> DataFrame:
    """Puts _z * c modulo 2**64 in the place of _z; one projection for each use, so that no expression is repeated."""
    c0, c1, c2, c3 = _parts(c)
    halves = df.withColumns({"_a": F.col("_z").bitwiseAND(_LOW), "_b": F.shiftrightunsigned("_z", 32)})
    up = lambda v, k: F.shiftleft(v * F.lit(k), 16)
    # Only the low 32 bits of the cross terms count, so each is made of 16-bit limbs.
    cross = F.col("_a") * F.lit(c2) + up(F.col("_a"), c3).bitwiseAND(_LOW) + F.col("_b") * F.lit(c0) + up(F.col("_b"), c1).bitwiseAND(_LOW)
    sums = halves.withColumns({"_p": F.col("_a") * F.lit(c0), "_q": up(F.col("_a"), c1), "_r": cross})
    low = sums.withColumn("_s", F.col("_p").bitwiseAND(_LOW) + F.col("_q").bitwiseAND(_LOW))
    high = F.shiftrightunsigned("_p", 32) + F.shiftrightunsigned("_q", 32) + F.shiftrightunsigned("_s", 32) + F.col("_r")
    return low.withColumn("_z", F.shiftleft(high, 32).bitwiseOR(F.col("_s").bitwiseAND(_LOW)))


def _folded(df: DataFrame, shift: int) -> DataFrame:
    return df.withColumn("_z", F.col("_z").bitwiseXOR(F.shiftrightunsigned("_z", shift)))


def with_mixed(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds splitmix64 of a bigint, as the bigint with the same bits."""
    start = df.withColumn("_v", value.cast("bigint"))
    low = start.withColumn("_s", F.col("_v").bitwiseAND(_LOW) + F.lit(INCREMENT & _LOW))
    z = low.withColumn("_z", F.shiftleft(F.shiftrightunsigned("_v", 32) + F.lit(INCREMENT >> 32) + F.shiftrightunsigned("_s", 32), 32).bitwiseOR(F.col("_s").bitwiseAND(_LOW)))
    z = _folded(_multiplied(_folded(_multiplied(_folded(z, 30), FIRST), 27), SECOND), 31)
    return z.withColumn(name, F.col("_z")).drop("_v", "_s", "_z", "_a", "_b", "_p", "_q", "_r")


def with_fingerprint(df: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Adds a classified row's fingerprint; no polygon counts as all ones."""
    key = F.shiftleft(F.col("point_id").cast("bigint"), 32).bitwiseXOR(F.coalesce(F.col("polygon_id").cast("bigint"), F.lit(-1).cast("bigint")))
    return with_mixed(df, key, name)


def hex64(v: Column) -> Column:
    """Unpadded lowercase hex of a bigint's bits."""
    return F.lower(F.hex(v))
