"""Planar geometry and the UTM projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_MILE = 1609.344
# WGS84, and zone 16 North by default.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_K0, _E0 = 0.9996, 500000.0
_R = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def utm(lon: Column, lat: Column, meridian: float = -87.0) -> tuple[Column, Column]:
    """Metres east and north of longitude and latitude, by Krueger's series."""
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    s = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - s * F.atanh(s * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _E0 + _K0 * _R * east, _K0 * _R * north


def lonlat(x: Column, y: Column, meridian: float = -87.0) -> tuple[Column, Column]:
    """Longitude and latitude of metres east and north; the inverse of utm()."""
    xi, eta = y / (_K0 * _R), (x - _E0) / (_K0 * _R)
    a, b = xi, eta
    for j, c in enumerate(_BETA, 1):
        a = a - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, c in enumerate(_DELTA, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def doubled_bearing(dx: Column, dy: Column, length: Column) -> tuple[Column, Column]:
    """Length-weighted sine and cosine of twice the direction, to be summed; see mean_bearing()."""
    safe = F.when(length > 0, length)
    sin2, cos2 = 2 * dx * dy / safe, (dx * dx - dy * dy) / safe
    return F.coalesce(sin2, F.lit(0.0)), F.coalesce(cos2, F.lit(0.0))


def mean_bearing(sin2: Column, cos2: Column) -> Column:
    """Undirected mean direction in degrees, [0, 180); null where nothing has a direction."""
    undefined = (F.abs(sin2) < 1e-12) & (F.abs(cos2) < 1e-12)
    return F.when(~undefined, F.pmod(F.degrees(F.atan2(sin2, cos2)) / 2, F.lit(180.0)))


def bearing_delta(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 180 - d)


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Fraction along a segment of the point on it that is nearest to p, [0, 1]."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    return F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)


def point_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    t = along(px, py, x1, y1, x2, y2)
    return distance(px, py, x1 + t * (x2 - x1), y1 + t * (y2 - y1))


def within(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column, r: Column) -> Column:
    """struct<lo, hi>: the stretch of segment A-B, as fractions, within r of segment C-D; null if there is none.

    Distance to a segment is convex along a line, so the stretch is one interval: the hull of the parts
    inside the two end discs and inside the slab between the ends.
    """
    ux, uy = bx - ax, by - ay

    def disc(qx: Column, qy: Column) -> tuple[Column, Column]:
        a, b = ux * ux + uy * uy, ux * (ax - qx) + uy * (ay - qy)
        c = (ax - qx) * (ax - qx) + (ay - qy) * (ay - qy) - r * r
        root = F.sqrt(F.when((a > 0) & (b * b - a * c >= 0), b * b - a * c))
        still = F.when((a == 0) & (c <= 0), 0.0)
        return F.coalesce((-b - root) / a, still), F.coalesce((-b + root) / a, F.when(still.isNotNull(), 1.0))

    wx, wy = dx - cx, dy - cy
    length = F.sqrt(wx * wx + wy * wy)

    def band(p0: Column, slope: Column, low: Column, high: Column) -> tuple[Column, Column]:
        """t with low <= p0 + slope t <= high."""
        flat = F.abs(slope) < 1e-15
        inside = (p0 >= low) & (p0 <= high)
        a, b = (low - p0) / slope, (high - p0) / slope
        return F.when(flat, F.when(inside, -1e18)).otherwise(F.least(a, b)), F.when(flat, F.when(inside, 1e18)).otherwise(F.greatest(a, b))

    ex, ey = wx / F.when(length > 0, length), wy / F.when(length > 0, length)
    l1, h1 = band((ax - cx) * ex + (ay - cy) * ey, ux * ex + uy * ey, F.lit(0.0), length)
    l2, h2 = band((ay - cy) * ex - (ax - cx) * ey, uy * ex - ux * ey, -r, r)
    lo, hi = F.when(l1.isNotNull() & l2.isNotNull(), F.greatest(l1, l2)), F.when(h1.isNotNull() & h2.isNotNull(), F.least(h1, h2))
    pieces = F.filter(F.array(*(F.struct(a.alias("lo"), b.alias("hi")) for a, b in ((lo, hi), disc(cx, cy), disc(dx, dy)))), lambda s: s["lo"].isNotNull() & (s["lo"] <= s["hi"]) & (s["hi"] >= 0) & (s["lo"] <= 1))
    low = F.greatest(F.lit(0.0), F.array_min(F.transform(pieces, lambda s: s["lo"])))
    high = F.least(F.lit(1.0), F.array_max(F.transform(pieces, lambda s: s["hi"])))
    return F.when(F.size(pieces) > 0, F.struct(low.alias("lo"), high.alias("hi")))


def rounded(x: Column, decimals: int = 5) -> Column:
    return F.round(x, decimals)
