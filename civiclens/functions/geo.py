"""Geometry as column expressions (X1-X7): rings are array<array<double>> of [x, y].

Everything is built-in Spark SQL (`aggregate`, `transform`, trigonometry), so it
runs inside whole-stage codegen on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from civiclens.constants import EARTH_RADIUS_KM


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km; a NULL input gives NULL.

    The root is clamped with CASE, not `least`, because `least` skips NULLs."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    s1, s2 = F.sin(dlat / 2), F.sin(dlon / 2)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    root = F.sqrt(a)
    root = F.when(root > 1, F.lit(1.0)).otherwise(root)
    return F.lit(radius) * 2 * F.asin(root)


def ring_is_valid(ring) -> Column:
    """A ring makes a polygon when it has at least 4 coordinates once closed."""
    r = _c(ring)
    n = F.size(r)
    closed = F.get(r, 0) == F.get(r, n - 1)
    return r.isNotNull() & (n + F.when(closed, 0).otherwise(1) >= 4)



def ring_vertex_mean(ring) -> Column:
    """Plain mean of the ring's vertices (a closing vertex counts twice).
    Returns struct(lat, lon)."""
    r = _c(ring)
    n = F.size(r)
    sx = F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p[0])
    sy = F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p[1])
    ok = r.isNotNull() & (n > 0)
    return F.struct(F.when(ok, sy / n).alias("lat"), F.when(ok, sx / n).alias("lon"))


_TERMS = ("a", "sx", "sy", "l", "lx", "ly")


def ring_shoelace(ring, finish=None) -> Column:
    """Sums over the edges of one ring: struct(a, sx, sy, l, lx, ly, x0, y0), or what `finish` makes of it inside the fold.
    a, sx, sy: twice the area and its moments; l, lx, ly: length of the boundary and its moments; coordinates are
    shifted by the first vertex (x0, y0) before the products (precision). Edges run i -> (i+1) mod n, so
    open and closed rings give the same answer. `ring` should be a column reference."""
    r = _c(ring)
    n = F.size(r)
    x0, y0 = F.get(r, 0)[0], F.get(r, 0)[1]

    def step(acc, i):
        p, q = F.get(r, i), F.get(r, (i + 1) % n)
        xi, yi = p[0] - x0, p[1] - y0
        xj, yj = q[0] - x0, q[1] - y0
        cross = xi * yj - xj * yi
        length = F.sqrt((xj - xi) * (xj - xi) + (yj - yi) * (yj - yi))
        add = (cross, (xi + xj) * cross, (yi + yj) * cross, length, (xi + xj) / 2 * length, (yi + yj) / 2 * length)
        return F.struct(*[(acc[t] + v).alias(t) for t, v in zip(_TERMS, add, strict=True)])

    # The origin is added in the finish step, so the traversal appears once in the plan.
    last = lambda acc: F.struct(*[acc[t].alias(t) for t in _TERMS], x0.alias("x0"), y0.alias("y0"))
    s = F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(*[F.lit(0.0).alias(t) for t in _TERMS]), step,
                    (lambda acc: finish(last(acc))) if finish else last)
    return F.when(r.isNotNull() & (n >= 3), s)


def shoelace_centroid(s) -> Column:
    """struct(x, y, area) from a `ring_shoelace` struct: the area's centroid; for a ring without area that of its
    boundary, and the point itself for a ring of one point. NULLs for NULL."""
    s = _c(s)
    at = lambda v: F.when(s["a"] != 0, s[f"s{v}"] / (s["a"] * 3)).when(s["l"] > 0, s[f"l{v}"] / s["l"]).otherwise(F.lit(0.0)) + s[f"{v}0"]
    return F.struct(at("x").alias("x"), at("y").alias("y"), (s["a"] / 2).alias("area"))


def ring_area_centroid(ring) -> Column:
    """struct(x, y, area, length, lx, ly) of one ring: `shoelace_centroid`, and the boundary's length and centroid."""
    def finish(s):
        line = lambda v: F.when(s["l"] > 0, s[f"l{v}"] / s["l"]).otherwise(F.lit(0.0)) + s[f"{v}0"]
        c = shoelace_centroid(s)
        return F.struct(c["x"].alias("x"), c["y"].alias("y"), c["area"].alias("area"), s["l"].alias("length"), line("x").alias("lx"), line("y").alias("ly"))
    return ring_shoelace(ring, finish)


def parts_area_centroid(parts) -> Column:
    """X4, multi-part: area-weighted centroid over parts -> rings -> points. In each
    part the first ring is the shell (weight +|area|) and the others are holes
    (weight -|area|), whatever their winding. Without any area the boundaries' length-weighted centroid;
    without length the mean of the rings' points. Returns struct(x, y, area); NULLs for no ring of 3 points."""
    def part_terms(part):
        return F.transform(part, lambda r, i: F.struct(
            ring_area_centroid(r).alias("c"), F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign")))
    terms = F.flatten(F.transform(_c(parts), part_terms))
    names = (*_TERMS, "n", "px", "py")

    def add(acc, t):
        c = t["c"]
        w, l, one = F.abs(c["area"]) * t["sign"], c["length"], F.lit(1.0)
        new = (w, c["x"] * w, c["y"] * w, l, c["lx"] * l, c["ly"] * l, one, c["lx"], c["ly"])
        return F.struct(*[(acc[k] + F.when(c.isNotNull(), v).otherwise(F.lit(0.0))).alias(k) for k, v in zip(names, new, strict=True)])

    s = F.aggregate(terms, F.struct(*[F.lit(0.0).alias(k) for k in names]), add)
    at = lambda v: (F.when(s["a"] != 0, s[f"s{v}"] / s["a"]).when(s["l"] > 0, s[f"l{v}"] / s["l"])
                    .when(s["n"] > 0, s[f"p{v}"] / s["n"]))
    return F.struct(at("x").alias("x"), at("y").alias("y"), F.when(s["n"] > 0, s["a"]).alias("area"))


# --- X5: WGS84 (EPSG:4326) <-> British National Grid (EPSG:27700) ------------------
# The projection itself is staged into columns in operators/geometry.py (each
# iteration refers to the previous one several times, so one nested expression
# would grow exponentially); the constants and the closed-form pieces live here.
# FIXED VALUES -- published Ordnance Survey constants: Airy 1830 and GRS80 ellipsoids,
# the National Grid projection and the 7-parameter Helmert transform WGS84 -> OSGB36.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
GRS80_A, GRS80_B = 6378137.000, 6356752.3141
NG_F0 = 0.9996012717
NG_LAT0, NG_LON0 = 49.0, -2.0
NG_E0, NG_N0 = 400000.0, -100000.0
HELMERT_TX, HELMERT_TY, HELMERT_TZ = -446.448, 125.157, -542.060
HELMERT_S_PPM = 20.4894
HELMERT_RX, HELMERT_RY, HELMERT_RZ = -0.1502, -0.2470, -0.8421  # arc-seconds


def helmert_terms(sign: float) -> tuple:
    """Rows of the transform: factors of x, y, z and what is added."""
    s = sign * HELMERT_S_PPM * 1e-6
    k = sign * math.pi / (180 * 3600)
    rx, ry, rz = HELMERT_RX * k, HELMERT_RY * k, HELMERT_RZ * k
    return ((1 + s, -rz, ry, sign * HELMERT_TX), (rz, 1 + s, -rx, sign * HELMERT_TY), (-ry, rx, 1 + s, sign * HELMERT_TZ))


def arc_terms() -> tuple:
    """Factors of the meridional arc's terms in d, sin d cos s, sin 2d cos 2s, sin 3d cos 3s (d, s: difference and sum
    of the latitude and the origin's)."""
    n, k = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B), AIRY_B * NG_F0
    return (k * (1 + n + 1.25 * n ** 2 + 1.25 * n ** 3), -k * (3 * n + 3 * n ** 2 + 21 / 8 * n ** 3),
            k * (15 / 8 * n ** 2 + 15 / 8 * n ** 3), -k * 35 / 24 * n ** 3)


def _helmert(x, y, z, sign: float):
    return tuple(x * a + y * b + z * c + t for a, b, c, t in helmert_terms(sign))


def _meridional_arc(phi):
    phi0 = math.radians(NG_LAT0)
    d, s = phi - phi0, phi + phi0
    one, two, three, four = arc_terms()
    return one * d + two * F.sin(d) * F.cos(s) + three * F.sin(2 * d) * F.cos(2 * s) + four * F.sin(3 * d) * F.cos(3 * s)
