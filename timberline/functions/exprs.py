"""Column expressions that point-cloud operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_div(v: Column | str, step: float) -> Column:
    """Floor division by remainder, as LONG: 1.0 by 0.1 is 9 (the remainder is just under 0.1), where floor(1.0 / 0.1) is 10."""
    v = col(v)
    return F.round((v - F.pmod(v, F.lit(float(step)))) / F.lit(float(step))).cast("long")


def rounded(v: Column | str, digits: int) -> Column:
    """Rounding as SQL engines on doubles do it: scaled up, to the nearest whole number (halves away from 0), scaled down. Spark's own rounds the decimal
    that the number is printed as, which differs at ties: 3 / 20000 to four places is 0.0001 here (it is just below 1.5 when scaled), and 0.0002 there."""
    scale = F.lit(10.0**digits)
    return F.round(col(v) * scale) / scale


def snap(v: Column | str, step: float) -> Column:
    """The lower edge of v's interval on the lattice of `step`."""
    return floor_div(v, step) * F.lit(float(step))


def dist2(a: Sequence[Column | str], b: Sequence[Column | str]) -> Column:
    """Squared distance, by products in order of the dimensions, so that other engines give the same bits."""
    total = None
    for x, y in zip(a, b, strict=True):
        d = col(x) - col(y)
        total = d * d if total is None else total + d * d
    return total


def isclose(a: Column | str, b: Column | float, atol: float = 1e-8, rtol: float = 1e-5) -> Column:
    b = F.lit(b) if isinstance(b, (int, float)) else b
    return F.abs(col(a) - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def argmax(values: Column | str) -> Column:
    """Place (from 0) of the greatest entry of an array, the first of equals."""
    values = col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(values: Column | str) -> Column:
    values = col(values)
    most = F.array_max(values)
    exps = F.transform(values, lambda v: F.exp(v - most))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def unit(*cols: Column | str, seed: int = 0) -> Column:
    """A seeded number in [0, 1) that depends on the values alone, whatever the partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[col(c) for c in cols]), 11) * F.lit(2.0**-53)


def integer_order(c: Column | str, seed: int = 0) -> Column:
    """A seeded order of integer ids by multiplication in a prime field; SQL without hash functions can give the same."""
    return F.pmod((F.pmod(col(c), F.lit(1_000_003)) + F.lit(seed)) * F.lit(48_271), F.lit(2_147_483_647))


def rotate(x: Column, y: Column, z: Column, roll: Column, pitch: Column, yaw: Column) -> list[Column]:
    """Rotation of a row vector about x, then y, then z, by angles in radians."""
    c, s = F.cos(roll), F.sin(roll)
    y, z = y * c - z * s, y * s + z * c
    c, s = F.cos(pitch), F.sin(pitch)
    x, z = x * c + z * s, z * c - x * s
    c, s = F.cos(yaw), F.sin(yaw)
    x, y = x * c - y * s, x * s + y * c
    return [x, y, z]


def diameter_class(radius: Column | str) -> Column:
    """Lower edge of the tenth-of-a-metre class that the diameter lies in, with one decimal; null without a radius."""
    return F.when(col(radius).isNotNull(), F.format_string("%.1f", floor_div(2 * col(radius), 0.1) / F.lit(10.0)))
