"""Boxes, points, grids and polygons in metres (EPSG:26916), as Column expressions over plain doubles."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

STRIDE, SIZE = 112, 224
#: Area of use of the working CRS, degrees: west, south, east, north. Fixed values.
AREA_OF_USE = (-90.0, 23.97, -84.0, 84.0)


def boxes_meet(west, south, east, north, prefix: str = "") -> Column:
    """Closed test of the row's box (xmin..ymax) against another: touching edges count."""
    c = lambda name: F.col(prefix + name)
    return (c("xmin") <= east) & (c("xmax") >= west) & (c("ymin") <= north) & (c("ymax") >= south)


def within(x: Column, y: Column, px, py, radius) -> Column:
    """Inclusive distance test."""
    return (x - px) * (x - px) + (y - py) * (y - py) <= F.lit(radius) * F.lit(radius)


def box_holds(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Half-open: west and south edges belong to the box, east and north do not."""
    return (xmin <= x) & (x < xmax) & (ymin <= y) & (y < ymax)


def snap_down(x: Column, step) -> Column:
    return F.floor(x / step) * step


def cells(span: Column, step) -> Column:
    return F.greatest(F.lit(1), F.ceil(span / step)).cast("int")


def morton(x: Column, y: Column) -> Column:
    """The place of a cell on a space-filling curve: the bits of two whole numbers below 2^31 in turn, x in the lower place."""

    def spread(v: Column) -> Column:
        v = v.cast("long")
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def half_even(x: Column) -> Column:
    return F.rint(x).cast("int")


def buffered(west: Column, south: Column, east: Column, north: Column, by: float = 250.0) -> list[Column]:
    return [F.floor(west - by), F.floor(south - by), F.ceil(east + by), F.ceil(north + by)]


def in_area_of_use(west: Column, south: Column, east: Column, north: Column) -> Column:
    w, s, e, n = AREA_OF_USE
    return (west > w) & (south > s) & (east < e) & (north < n)


def covers(outer: list[Column], inner: list[Column]) -> Column:
    """Whether a box holds another (edges may touch); false where an edge is null."""
    return F.coalesce((outer[0] <= inner[0]) & (outer[1] <= inner[1]) & (outer[2] >= inner[2]) & (outer[3] >= inner[3]), F.lit(False))


def ring_edges(ring: list[tuple[float, float]]) -> list[tuple[float, float, float, float]]:
    """Edges of a ring, closed or not."""
    points = ring[:-1] if ring[0] == ring[-1] else ring
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1], strict=True)]


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(x1 * y2 - x2 * y1 for x1, y1, x2, y2 in ring_edges(ring)) / 2


def is_convex(ring: list[tuple[float, float]]) -> bool:
    edges = ring_edges(ring)
    turns = [(b[2] - b[0]) * (a[3] - a[1]) - (b[3] - b[1]) * (a[2] - a[0]) for a, b in zip(edges, edges[1:] + edges[:1], strict=True)]
    return all(t <= 0 for t in turns) or all(t >= 0 for t in turns)


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def polygon_holds_point(ring: list[tuple[float, float]], x: Column, y: Column, boundary: bool = True) -> Column:
    """Even-odd rule; points on the boundary count if ``boundary``."""
    crossings, on_edge = [], []
    for x1, y1, x2, y2 in ring_edges(ring):
        cross = (F.lit(x2) - x1) * (y - y1) - (F.lit(y2) - y1) * (x - x1)
        on_edge.append((cross == 0) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            hit = (F.lit(y1) <= y) != (F.lit(y2) <= y)
            crossings.append((hit & (x < F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1)))).cast("int"))
    inside = sum(crossings[1:], crossings[0]) % 2 == 1
    edge = reduce(lambda a, b: a | b, on_edge)
    return inside | edge if boundary else inside & ~edge


def polygon_holds_box(ring: list[tuple[float, float]], xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether the whole box lies in the polygon. Convex: all corners on the inner side of every edge; else no edge may enter the box too."""
    corners = [(xmin, ymin), (xmin, ymax), (xmax, ymin), (xmax, ymax)]
    if is_convex(ring):
        sign = 1.0 if signed_area(ring) > 0 else -1.0
        return _all([((F.lit(x2) - x1) * (y - y1) - (F.lit(y2) - y1) * (x - x1)) * sign >= 0 for x1, y1, x2, y2 in ring_edges(ring) for x, y in corners])
    inside = [polygon_holds_point(ring, x, y) for x, y in corners]
    clear = [~_enters(edge, xmin, ymin, xmax, ymax) for edge in ring_edges(ring)]
    return _all(inside + clear)


def _enters(edge, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether a segment has points in the open box: it is clipped to the box (Liang-Barsky)."""
    x1, y1, x2, y2 = edge
    lows, highs, out = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for d, start, low, high in ((x2 - x1, x1, xmin, xmax), (y2 - y1, y1, ymin, ymax)):
        if d == 0:
            out = out | (F.lit(start) <= low) | (F.lit(start) >= high)
        else:
            a, b = (low - start) / d, (high - start) / d
            lows.append(F.least(a, b))
            highs.append(F.greatest(a, b))
    return ~out & (F.greatest(*lows) < F.least(*highs) if len(lows) > 1 else ~out)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371008.8) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(a))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, steps: int = 30) -> Column:
    """Metres along the ellipsoid (GRS80) between points in degrees, by Vincenty's inverse iteration; null if it has not settled.

    It does not settle between nearly antipodal points. Equal points are 0 apart. Batches are computed by NumPy: as nested
    expressions each step is evaluated many times over, as is the body of a lambda function.
    """

    @F.pandas_udf("double")
    def metres(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        return pd.Series(vincenty(*(np.asarray(v, np.float64) for v in (lon1, lat1, lon2, lat2)), steps))

    return metres(lon1, lat1, lon2, lat2)


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, steps: int) -> np.ndarray:
    """``geodesic`` of arrays; NaN if it has not settled."""
    f = 1 / INV_F
    b = A * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(lat))) for lat in (lat1, lat2))
    s1, c1, s2, c2, span = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2), np.radians(lon2 - lon1)

    def parts(lam: np.ndarray) -> tuple[np.ndarray, ...]:
        sin = np.sqrt((c2 * np.sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * np.cos(lam)) ** 2)
        cos = s1 * s2 + c1 * c2 * np.cos(lam)
        alpha = np.where(sin == 0, 0.0, c1 * c2 * np.sin(lam) / sin)  # the sine of the azimuth at the equator
        square = 1 - alpha * alpha
        middle = np.where(square == 0, 0.0, cos - 2 * s1 * s2 / square)
        return sin, cos, np.arctan2(sin, cos), alpha, square, middle

    with np.errstate(invalid="ignore", divide="ignore"):
        lam, moved = span, np.ones(span.shape)
        for _ in range(steps):
            sin, cos, sigma, alpha, square, middle = parts(lam)
            c = f / 16 * square * (4 + f * (4 - 3 * square))
            now = span + (1 - c) * f * alpha * (sigma + c * sin * (middle + c * cos * (2 * middle * middle - 1)))
            settled = moved < 1e-13
            if settled.all():
                break
            lam, moved = np.where(settled, lam, now), np.where(settled, moved, np.abs(now - lam))
        sin, cos, sigma, _, square, middle = parts(lam)
        u = square * (A * A - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        change = small * sin * (middle + small / 4 * (cos * (2 * middle * middle - 1) - small / 6 * middle * (4 * sin * sin - 3) * (4 * middle * middle - 3)))
        return np.where(moved < 1e-12, b * big * (sigma - change), np.nan)


# UTM zone 16 north on GRS80. Fixed values of the projection.
A, INV_F, K0, LON0, EAST0 = 6378137.0, 298.257222101, 0.9996, -87.0, 500000.0
_f = 1 / INV_F
_n = _f / (2 - _f)
E1 = math.sqrt(_f * (2 - _f))
RECTIFYING = A / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64 + _n**6 / 256)
# Krueger's series for the transverse Mercator projection, to the fourth order.
FORWARD = (
    _n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180,
    13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
    61 * _n**3 / 240 - 103 * _n**4 / 140,
    49561 * _n**4 / 161280,
)
INVERSE = (
    _n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96 - _n**4 / 360,
    _n**2 / 48 + _n**3 / 15 - 437 * _n**4 / 1440,
    17 * _n**3 / 480 - 37 * _n**4 / 840,
    4397 * _n**4 / 161280,
)


def to_utm(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(x, y) in metres of degrees."""
    phi, lam = F.radians(lat), F.radians(lon - LON0)
    t = F.sinh(F.atanh(F.sin(phi)) - E1 * F.atanh(E1 * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    north, east = xi, eta
    for j, c in enumerate(FORWARD, 1):
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return EAST0 + K0 * RECTIFYING * east, K0 * RECTIFYING * north


def to_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees of metres: the inverse series, then Newton steps on tan(lat)."""
    north, east = y / (K0 * RECTIFYING), (x - EAST0) / (K0 * RECTIFYING)
    xi, eta = north, east
    for j, c in enumerate(INVERSE, 1):
        xi = xi - c * F.sin(2 * j * north) * F.cosh(2 * j * east)
        eta = eta - c * F.cos(2 * j * north) * F.sinh(2 * j * east)
    target = F.sin(xi) / F.sqrt(F.pow(F.sinh(eta), 2) + F.pow(F.cos(xi), 2))

    def step(tau: Column) -> Column:
        s = F.sinh(E1 * F.atanh(E1 * tau / F.sqrt(1 + tau * tau)))
        now = tau * F.sqrt(1 + s * s) - s * F.sqrt(1 + tau * tau)
        return tau + (target - now) / F.sqrt(1 + now * now) * (1 + (1 - E1**2) * tau * tau) / ((1 - E1**2) * F.sqrt(1 + tau * tau))

    # aggregate() keeps each step's value, where nested expressions would repeat it.
    tau = F.aggregate(F.sequence(F.lit(1), F.lit(3)), target, lambda t, _: step(t))
    return LON0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(F.atan(tau))
