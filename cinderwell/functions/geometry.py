"""Planar geometry as Catalyst higher-order-function expressions.

Polygons are ``rings: array<array<struct<x:double,y:double>>>`` — every ring
closed (first vertex repeated last); outer rings and holes are not told apart
because the even-odd rule treats holes and multi-part shapes uniformly.
No Python runs per row: all of this compiles to JVM expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<array<struct<x:double,y:double>>>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _edge_indices(ring: Column) -> Column:
    # 0 .. size-2; empty for degenerate rings (sequence(0,-1) would count down).
    return F.when(F.size(ring) >= 2, F.sequence(F.lit(0), F.size(ring) - 2)) \
            .otherwise(F.array().cast("array<int>"))


def side(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """1 where (px, py) is left of the line from a to b, -1 right of it, 0 on it.

    The sign of the float determinant counts where its error cannot change it.
    Elsewhere the coordinates are taken as decimals of 12 places, as layers are
    published, and the determinant is exact (36 of 38 digits). Coordinates
    beyond 9999 have the float sign.
    """
    dx, dy, ex, ey = bx - ax, by - ay, px - ax, py - ay
    det = dx * ey - dy * ex
    error = (F.abs(dx) + F.abs(dy) + F.abs(ex) + F.abs(ey)) * 1e-11 + (F.abs(dx * ey) + F.abs(dy * ex)) * 1e-15 + 1e-22
    dax, day, dbx, dby, dpx, dpy = (v.try_cast("decimal(16,12)") for v in (ax, ay, bx, by, px, py))
    exact = (dbx - dax) * (dpy - day) - (dby - day) * (dpx - dax)
    return F.when(F.abs(det) <= error, F.coalesce(F.signum(exact), F.signum(det))).otherwise(F.signum(det)).cast("int")


def crossings(px: Column, py: Column, rings) -> Column:
    """Number of ring edges crossed by the ray from (px,py) towards +x.

    Division-free form of the ray/edge test, so no edge can raise under ANSI
    division rules; which side of an edge the point is on comes from ``side``.
    """
    def ring_count(acc, ring):
        def crosses(i):
            a, b = ring[i], ring[i + 1]
            ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
            straddles = (ay > py) != (by > py)
            return straddles & ((side(ax, ay, bx, by, px, py) > 0) == (by > ay))
        return acc + F.size(F.filter(_edge_indices(ring), crosses))
    return F.aggregate(_c(rings), F.lit(0), ring_count)


def on_boundary(px: Column, py: Column, rings) -> Column:
    """True when the point lies on any edge (vertices included)."""
    def ring_hit(ring):
        def on_edge(i):
            a, b = ring[i], ring[i + 1]
            ax, ay, bx, by = a["x"], a["y"], b["x"], b["y"]
            in_x = (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx))
            in_y = (py >= F.least(ay, by)) & (py <= F.greatest(ay, by))
            return in_x & in_y & (side(ax, ay, bx, by, px, py) == 0)
        return F.exists(_edge_indices(ring), on_edge)
    return F.exists(_c(rings), ring_hit)


def within(px, py, rings) -> Column:
    """Strict point-in-polygon: odd crossing count and not on the boundary.
    NULL coordinates never match."""
    px, py = _c(px), _c(py)
    inside = (F.pmod(crossings(px, py, rings), F.lit(2)) == 1) & ~on_boundary(px, py, rings)
    return F.coalesce(px.isNotNull() & py.isNotNull() & inside, F.lit(False))


def bbox(rings) -> dict[str, Column]:
    """Bounding box of all vertices: dict of minx, miny, maxx, maxy columns."""
    pts = F.flatten(_c(rings))
    xs = F.transform(pts, lambda p: p["x"])
    ys = F.transform(pts, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys),
            "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def cell_index(v, cell: float) -> Column:
    """Grid cell of a coordinate."""
    return F.floor(_c(v) / F.lit(float(cell))).cast("long")


def cell_range(lo, hi, cell: float) -> Column:
    """All grid cells a [lo, hi] extent touches (as an array to explode)."""
    return F.sequence(cell_index(lo, cell), cell_index(hi, cell))


def wkt_point(lon, lat) -> Column:
    """WKT text of a point."""
    return F.format_string("POINT (%s %s)", _c(lon).cast("string"), _c(lat).cast("string"))


# ---------------------------------------------------------------------------
# Inverse Albers equal-area conic (ellipsoid), closed form after Snyder,
# "Map Projections — A Working Manual" (USGS PP 1395, 1987), eqs. 14-18..14-21
# with the series 3-18 for latitude from authalic latitude.
# ---------------------------------------------------------------------------

# GRS80 ellipsoid.
GRS80_A = 6378137.0
GRS80_E2 = 0.00669438002290


def _q(phi, e2):
    e = math.sqrt(e2)
    s = math.sin(phi)
    return (1 - e2) * (s / (1 - e2 * s * s)
                       - (1 / (2 * e)) * math.log((1 - e * s) / (1 + e * s)))


def _m(phi, e2):
    s = math.sin(phi)
    return math.cos(phi) / math.sqrt(1 - e2 * s * s)


class AlbersParams:
    """Albers parameters in degrees/metres. Defaults: the usual California
    Albers layout (parallels 34 and 40.5, origin 0N 120W, false northing
    -4,000,000 m)."""

    def __init__(self, lat1=34.0, lat2=40.5, lat0=0.0, lon0=-120.0,
                 false_easting=0.0, false_northing=-4_000_000.0,
                 a=GRS80_A, e2=GRS80_E2):
        self.a, self.e2 = a, e2
        p1, p2, p0 = map(math.radians, (lat1, lat2, lat0))
        m1, m2 = _m(p1, e2), _m(p2, e2)
        q1, q2, q0 = _q(p1, e2), _q(p2, e2), _q(p0, e2)
        self.n = (m1 * m1 - m2 * m2) / (q2 - q1)
        self.C = m1 * m1 + self.n * q1
        self.rho0 = a * math.sqrt(self.C - self.n * q0) / self.n
        self.qp = _q(math.pi / 2, e2)
        self.lon0 = math.radians(lon0)
        self.fe, self.fn = false_easting, false_northing

    def forward(self, lon_deg: float, lat_deg: float) -> tuple[float, float]:
        """Plain-Python forward projection (for tests and fixtures)."""
        phi, lam = math.radians(lat_deg), math.radians(lon_deg)
        rho = self.a * math.sqrt(self.C - self.n * _q(phi, self.e2)) / self.n
        theta = self.n * (lam - self.lon0)
        return (self.fe + rho * math.sin(theta), self.fn + self.rho0 - rho * math.cos(theta))

    def series(self):
        e2 = self.e2
        e4, e6 = e2 * e2, e2 * e2 * e2
        return (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040,
                23 * e4 / 360 + 251 * e6 / 3780,
                761 * e6 / 45360)


def albers_inverse(x, y, params: AlbersParams | None = None) -> Column:
    """Projected metres to a struct<x: lon, y: lat> in degrees."""
    p = params or AlbersParams()
    xs = _c(x) - F.lit(p.fe)
    ys = F.lit(p.rho0) - (_c(y) - F.lit(p.fn))
    rho = F.sqrt(xs * xs + ys * ys)
    theta = F.atan2(xs, ys) if p.n > 0 else F.atan2(-xs, -ys)
    q = (F.lit(p.C) - rho * rho * F.lit(p.n * p.n / (p.a * p.a))) / F.lit(p.n)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / F.lit(p.qp))))
    c1, c2, c3 = p.series()
    phi = beta + F.lit(c1) * F.sin(2 * beta) + F.lit(c2) * F.sin(4 * beta) + F.lit(c3) * F.sin(6 * beta)
    lam = F.lit(p.lon0) + theta / F.lit(p.n)
    return F.struct(F.degrees(lam).alias("x"), F.degrees(phi).alias("y"))


def reproject_rings(rings, params: AlbersParams | None = None) -> Column:
    """P16 over a whole polygon column; ``params=None`` means identity."""
    if params is None:
        return _c(rings)
    return F.transform(_c(rings), lambda r: F.transform(
        r, lambda pt: albers_inverse(pt["x"], pt["y"], params)))
