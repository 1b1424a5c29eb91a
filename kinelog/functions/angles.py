"""Angles, frames and shapes as column expressions, so that they stay in generated code."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DRAWN, DRAWN_ELSE

#: Up to here whole turns are counted by ``floor``, which gives a long.
LARGEST = 1e15


def wrap(angle: Column) -> Column:
    """Into [-pi, pi), by the terms that SQL spells out: a last bit below -pi comes out as pi there, which ``pmod`` takes to -pi."""
    turned = angle + F.pi()
    return F.when(F.abs(angle) < LARGEST, turned - 2 * F.pi() * F.floor(turned / (2 * F.pi())) - F.pi()).otherwise(F.pmod(turned, 2 * F.pi()) - F.pi())


def in_libm(f, *arguments: Column) -> Column:
    """``f`` of doubles in Python, whose ``math`` is the C library that DuckDB calls; the JVM's sine, cosine and arc tangent differ from it in the last bit.

    For the few rows where that bit decides; rows with a null argument are null and aren't computed.
    """
    def apply(*columns: pd.Series) -> pd.Series:
        rows = pd.concat(columns, axis=1, keys=range(len(columns)))
        there = rows[rows.notna().all(axis=1)]
        return pd.Series([f(*row) for row in there.itertuples(index=False, name=None)], there.index, float).reindex(rows.index)

    return F.pandas_udf(apply, "double")(*arguments)


def wrapped_turn(ax: float, ay: float, bx: float, by: float) -> float:
    """``wrap`` of the angle from one vector to another."""
    turned = math.atan2(by, bx) - math.atan2(ay, ax) + math.pi
    return turned - 2 * math.pi * math.floor(turned / (2 * math.pi)) - math.pi


def mean_direction(ax: float, ay: float, bx: float, by: float) -> float:
    """The circular mean of the directions of two vectors."""
    a, b = math.atan2(ay, ax), math.atan2(by, bx)
    return math.atan2(math.sin(a) + math.sin(b), math.cos(a) + math.cos(b))


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def to_frame(x: Column, y: Column, x0: Column, y0: Column, h0: Column) -> tuple[Column, Column]:
    """A place seen from (x0, y0, h0): shifted, then turned back."""
    return rotate(x - x0, y - y0, -h0)


def from_frame(x: Column, y: Column, x0: Column, y0: Column, h0: Column) -> tuple[Column, Column]:
    a, b = rotate(x, y, h0)
    return a + x0, b + y0


def frame_matrix(x: Column, y: Column, h: Column) -> Column:
    """The inverse of the pose as rows of a 3 x 3 matrix, in closed form."""
    c, s = F.cos(h), F.sin(h)
    return F.array(F.array(c, s, -(c * x + s * y)), F.array(-s, c, s * x - c * y), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0)))


def lon_lat(vx: Column, vy: Column, h: Column) -> tuple[Column, Column]:
    """Along and across the heading."""
    return vx * F.cos(h) + vy * F.sin(h), -vx * F.sin(h) + vy * F.cos(h)


def yaw(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Heading of a quaternion."""
    return F.atan2(2 * (w * z - x * y), 1 - 2 * (y * y + z * z))


def affine(m: list[list[float]], x: Column, y: Column, h: Column) -> tuple[Column, Column, Column]:
    """A 3 x 3 map of the plane applied to a pose."""
    turn = F.atan2(F.lit(float(m[1][0])), F.lit(float(m[0][0])))
    return m[0][0] * x + m[0][1] * y + m[0][2], m[1][0] * x + m[1][1] * y + m[1][2], wrap(h + turn)


def corners(x: Column, y: Column, h: Column, length: Column, width: Column) -> Column:
    """The four corners of a box, from the front left on against the clock."""
    def corner(a: float, b: float) -> Column:
        u, v = rotate(a * length, b * width, h)
        return F.struct((x + u).alias("x"), (y + v).alias("y"))

    return F.array(*(corner(a, b) for a, b in ((0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5), (0.5, -0.5))))


def drawn(agent_type: Column, length: Column, width: Column) -> tuple[Column, Column]:
    """The extent, or the usual one of the type where it is missing."""
    sides = []
    for i, own in enumerate((length, width)):
        usual = F.lit(DRAWN_ELSE[i])
        for t, size in DRAWN.items():
            usual = F.when(agent_type == t, size[i]).otherwise(usual)
        sides.append(F.coalesce(F.nanvl(own, F.lit(None)), usual))
    return sides[0], sides[1]


def enu(lat: Column, lon: Column, height: Column, lat0: Column, lon0: Column, height0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a place (degrees, metres, WGS 84) seen from another."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)

    def ecef(phi: Column, lam: Column, hh: Column) -> tuple[Column, Column, Column]:
        phi, lam = F.radians(phi), F.radians(lam)
        n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
        return (n + hh) * F.cos(phi) * F.cos(lam), (n + hh) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + hh) * F.sin(phi)

    p, q = ecef(lat, lon, height), ecef(lat0, lon0, height0)
    dx, dy, dz = (u - v for u, v in zip(p, q))
    phi, lam = F.radians(lat0), F.radians(lon0)
    east = -F.sin(lam) * dx + F.cos(lam) * dy
    north = -F.sin(phi) * F.cos(lam) * dx - F.sin(phi) * F.sin(lam) * dy + F.cos(phi) * dz
    up = F.cos(phi) * F.cos(lam) * dx + F.cos(phi) * F.sin(lam) * dy + F.sin(phi) * dz
    return east, north, up
