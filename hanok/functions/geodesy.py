"""Geodetic coordinates: transverse Mercator grids and datum shifts as column expressions.

A grid is projected by the series in the third flattening ``n`` (to its fourth power, far below a millimetre within a
zone) and read back by the inverse series. A grid on another ellipsoid reaches WGS 84 by a seven-parameter shift of the
geocentric coordinates. Intermediate values are bound once with :func:`let`, so an expression stays small also inside
a ``transform`` over an array of nodes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from hanok.functions.months import col, let


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def n(self) -> float:
        return 1 / (2 * self.inverse_flattening - 1)

    @property
    def e(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    @property
    def rectifying_radius(self) -> float:
        n = self.n
        return self.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


# Ellipsoids.
GRS80 = Ellipsoid(6378137.0, 298.257222101)
WGS84 = Ellipsoid(6378137.0, 298.257223563)
BESSEL = Ellipsoid(6377397.155, 299.1528128)


@dataclass(frozen=True)
class Grid:
    """A transverse Mercator grid; ``shift`` is (dx, dy, dz in m, rx, ry, rz in seconds of arc, scale in ppm) to WGS 84."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    scale: float
    x0: float
    y0: float
    shift: tuple[float, ...] | None = None


# The national grid of the walking network, and the grid in which official points are given.
NATIONAL_GRID = Grid(GRS80, 38.0, 127.5, 0.9996, 1_000_000.0, 2_000_000.0)
OFFICIAL_GRID = Grid(BESSEL, 38.0, 127.0028902777778, 1.0, 200_000.0, 500_000.0, (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43))


def _forward_terms(n: float) -> list[float]:
    return [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]


def _inverse_terms(n: float) -> list[float]:
    return [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]


def _latitude_terms(n: float) -> list[float]:
    return [
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    ]


def _origin(grid: Grid) -> float:
    """Rectified northing of the grid's latitude of origin, in radii."""
    e, s = grid.ellipsoid.e, math.sin(math.radians(grid.lat0))
    xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
    return xi + sum(c * math.sin(2 * (j + 1) * xi) for j, c in enumerate(_forward_terms(grid.ellipsoid.n)))


def _total(terms) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def grid_point(lon, lat, grid: Grid = NATIONAL_GRID) -> Column:
    """``STRUCT<x, y>`` in metres of a point in degrees on the grid's own ellipsoid; null where either is null."""
    e, radius = grid.ellipsoid.e, grid.scale * grid.ellipsoid.rectifying_radius
    terms = list(enumerate(_forward_terms(grid.ellipsoid.n)))

    def conformal(s):
        return F.sinh(F.atanh(s) - F.lit(e) * F.atanh(F.lit(e) * s))

    def around(t, turn):
        return F.struct(F.atan2(t, F.cos(turn)).alias("xi"), F.atanh(F.sin(turn) / F.sqrt(1 + t * t)).alias("eta"))

    def placed(p):
        xi, eta = p["xi"], p["eta"]
        east = eta + _total([F.lit(c) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in terms])
        north = xi + _total([F.lit(c) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in terms])
        return F.struct(
            (F.lit(grid.x0) + F.lit(radius) * east).alias("x"), (F.lit(grid.y0) + F.lit(radius) * (north - F.lit(_origin(grid)))).alias("y")
        )

    turn = F.radians(col(lon) - F.lit(grid.lon0))
    point = let(let(let(F.sin(F.radians(col(lat))), conformal), lambda t: around(t, turn)), placed)
    return F.when(col(lon).isNotNull() & col(lat).isNotNull(), point)


def grid_lonlat(x, y, grid: Grid = NATIONAL_GRID) -> Column:
    """``STRUCT<lon, lat>`` in degrees of a grid point, on WGS 84 if the grid has a shift, else on its own ellipsoid."""
    n, radius = grid.ellipsoid.n, grid.scale * grid.ellipsoid.rectifying_radius
    back, rise = list(enumerate(_inverse_terms(n))), list(enumerate(_latitude_terms(n)))

    def unrectified(p):
        xi, eta = p["xi"], p["eta"]
        return F.struct(
            (xi - _total([F.lit(c) * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in back])).alias("xi"),
            (eta - _total([F.lit(c) * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in back])).alias("eta"),
        )

    def angles(p):
        chi = F.asin(F.sin(p["xi"]) / F.cosh(p["eta"]))
        return F.struct(chi.alias("chi"), (F.lit(math.radians(grid.lon0)) + F.atan2(F.sinh(p["eta"]), F.cos(p["xi"]))).alias("lon"))

    def raised(p):
        lat = p["chi"] + _total([F.lit(c) * F.sin(2 * (j + 1) * p["chi"]) for j, c in rise])
        return F.struct(p["lon"].alias("lon"), lat.alias("lat"))

    flat = F.struct(((col(x) - F.lit(grid.x0)) / radius).alias("eta"), ((col(y) - F.lit(grid.y0)) / radius + F.lit(_origin(grid))).alias("xi"))
    own = let(let(let(flat, unrectified), angles), raised)
    if grid.shift:
        own = let(let(own, lambda p: shifted(geocentric(p, grid.ellipsoid), grid.shift)), lambda p: geodetic(p, WGS84))
    point = let(own, lambda p: F.struct(F.degrees(p["lon"]).alias("lon"), F.degrees(p["lat"]).alias("lat")))
    return F.when(col(x).isNotNull() & col(y).isNotNull(), point)


def geocentric(p: Column, on: Ellipsoid) -> Column:
    """``STRUCT<x, y, z>`` in metres of ``STRUCT<lon, lat>`` in radians at height zero."""
    normal = F.lit(on.a) / F.sqrt(1 - F.lit(on.e**2) * F.pow(F.sin(p["lat"]), F.lit(2)))
    return F.struct(
        (normal * F.cos(p["lat"]) * F.cos(p["lon"])).alias("x"), (normal * F.cos(p["lat"]) * F.sin(p["lon"])).alias("y"),
        (normal * F.lit(1 - on.e**2) * F.sin(p["lat"])).alias("z"),
    )


def shifted(p: Column, shift: tuple[float, ...]) -> Column:
    """Seven-parameter shift of geocentric coordinates; rotations turn the position vector."""
    dx, dy, dz = shift[:3]
    rx, ry, rz = (math.radians(s / 3600) for s in shift[3:6])
    m = 1 + shift[6] * 1e-6

    def turned(p):
        return F.struct(
            (F.lit(dx) + F.lit(m) * (p["x"] - F.lit(rz) * p["y"] + F.lit(ry) * p["z"])).alias("x"),
            (F.lit(dy) + F.lit(m) * (F.lit(rz) * p["x"] + p["y"] - F.lit(rx) * p["z"])).alias("y"),
            (F.lit(dz) + F.lit(m) * (F.lit(-ry) * p["x"] + F.lit(rx) * p["y"] + p["z"])).alias("z"),
        )

    return let(p, turned)


def geodetic(p: Column, on: Ellipsoid) -> Column:
    """``STRUCT<lon, lat>`` in radians of geocentric coordinates near the surface, from the reduced latitude."""
    b = on.a * (1 - 1 / on.inverse_flattening)
    second = (on.a**2 - b**2) / b**2
    across = F.hypot(p["x"], p["y"])
    reduced = F.atan2(p["z"] * F.lit(on.a), across * F.lit(b))
    lat = F.atan2(
        p["z"] + F.lit(second * b) * F.pow(F.sin(reduced), F.lit(3)), across - F.lit(on.e**2 * on.a) * F.pow(F.cos(reduced), F.lit(3))
    )
    return F.struct(F.atan2(p["y"], p["x"]).alias("lon"), lat.alias("lat"))
