"""Geometry at DataFrame level: each step is a column of its own, so a heavy
expression (a ring traversal, one iteration of a projection) is evaluated once per
row instead of being copied into every expression that uses it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiclens.functions import geo as X


def with_outer_ring(df: DataFrame, coords: str, out: str = "_ring") -> DataFrame:
    """Outer ring of a polygon coordinate column, NULL when it cannot form a polygon."""
    df = df.withColumn("_ring0", F.get(F.col(coords), 0))
    return df.withColumn(out, F.when(X.ring_is_valid(F.col("_ring0")), F.col("_ring0"))).drop("_ring0")


def with_area_centroid(df: DataFrame, ring: str, x: str, y: str, area: str | None = None) -> DataFrame:
    """Planar area centroid of the ring column; of its boundary if it has no area. NULL for fewer than 3 points."""
    df = df.withColumn("_sl", X.ring_shoelace(F.col(ring))).withColumn("_ct", X.shoelace_centroid(F.col("_sl")))
    cols = {x: F.col("_ct.x"), y: F.col("_ct.y")}
    if area:
        cols[area] = F.col("_ct.area")
    return df.withColumns(cols).drop("_sl", "_ct")


def with_vertex_mean(df: DataFrame, ring: str, lat: str, lon: str) -> DataFrame:
    """Mean of the ring's vertices."""
    return (df.withColumn("_vm", X.ring_vertex_mean(F.col(ring)))
            .withColumns({lat: F.col("_vm.lat"), lon: F.col("_vm.lon")}).drop("_vm"))


# -- X5 in stages -----------------------------------------------------------------------
def _stage(df: DataFrame, cols: dict) -> DataFrame:
    return df.withColumns(cols)


def _to_cart(df, lat, lon, a, b, pre):
    e2 = 1 - (b * b) / (a * a)
    df = _stage(df, {f"{pre}sp": F.sin(F.col(lat)), f"{pre}cp": F.cos(F.col(lat))})
    df = _stage(df, {f"{pre}nu": F.lit(a) / F.sqrt(1 - e2 * F.col(f"{pre}sp") * F.col(f"{pre}sp"))})
    nu, cp, sp = F.col(f"{pre}nu"), F.col(f"{pre}cp"), F.col(f"{pre}sp")
    return _stage(df, {f"{pre}x": nu * cp * F.cos(F.col(lon)), f"{pre}y": nu * cp * F.sin(F.col(lon)),
                       f"{pre}z": nu * (1 - e2) * sp})


def _helmert(df, pre, out, sign):
    x, y, z = F.col(f"{pre}x"), F.col(f"{pre}y"), F.col(f"{pre}z")
    hx, hy, hz = X._helmert(x, y, z, sign)
    return _stage(df, {f"{out}x": hx, f"{out}y": hy, f"{out}z": hz})


def _to_geodetic(df, pre, a, b, lat_out, lon_out, iterations=5):
    e2 = 1 - (b * b) / (a * a)
    x, y, z = F.col(f"{pre}x"), F.col(f"{pre}y"), F.col(f"{pre}z")
    df = _stage(df, {f"{pre}p": F.sqrt(x * x + y * y)})
    df = _stage(df, {f"{pre}l0": F.atan2(z, F.col(f"{pre}p") * (1 - e2))})
    for k in range(iterations):
        lk = F.col(f"{pre}l{k}")
        df = _stage(df, {f"{pre}s{k}": F.sin(lk)})
        sk = F.col(f"{pre}s{k}")
        df = _stage(df, {f"{pre}l{k + 1}": F.atan2(z + e2 * (F.lit(a) / F.sqrt(1 - e2 * sk * sk)) * sk,
                                                   F.col(f"{pre}p"))})
    return _stage(df, {lat_out: F.col(f"{pre}l{iterations}"), lon_out: F.atan2(y, x)})


def _temp_cols(df: DataFrame, before: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return df.drop(*[c for c in df.columns if c not in before and c not in keep])


def with_bng(df: DataFrame, lat: str, lon: str, e: str = "bng_e", n: str = "bng_n",
             datum_shift: bool = True) -> DataFrame:
    """WGS84 (lat, lon degrees) -> National Grid (e, n metres), staged.
    datum_shift=False takes OSGB36 (Airy) latitude/longitude directly."""
    before = list(df.columns)
    df = _stage(df, {"_b_lat": F.radians(F.col(lat)), "_b_lon": F.radians(F.col(lon))})
    if datum_shift:
        df = _to_cart(df, "_b_lat", "_b_lon", X.GRS80_A, X.GRS80_B, "_b_c")
        df = _helmert(df, "_b_c", "_b_h", 1.0)
        df = _to_geodetic(df, "_b_h", X.AIRY_A, X.AIRY_B, "_b_phi", "_b_lam")
    else:
        df = _stage(df, {"_b_phi": F.col("_b_lat"), "_b_lam": F.col("_b_lon")})
    a, b, f0 = X.AIRY_A, X.AIRY_B, X.NG_F0
    e2 = 1 - (b * b) / (a * a)
    phi = F.col("_b_phi")
    df = _stage(df, {"_b_sp": F.sin(phi), "_b_cp": F.cos(phi), "_b_tp": F.tan(phi), "_b_m": X._meridional_arc(phi),
                     "_b_dl": F.col("_b_lam") - math.radians(X.NG_LON0)})
    sp, cp, tp = F.col("_b_sp"), F.col("_b_cp"), F.col("_b_tp")
    df = _stage(df, {"_b_nu": a * f0 / F.sqrt(1 - e2 * sp * sp),
                     "_b_rho": a * f0 * (1 - e2) * F.pow(1 - e2 * sp * sp, -1.5)})
    nu, rho, dl = F.col("_b_nu"), F.col("_b_rho"), F.col("_b_dl")
    df = _stage(df, {"_b_eta2": nu / rho - 1})
    eta2 = F.col("_b_eta2")
    df = _stage(df, {
        "_b_i": F.col("_b_m") + X.NG_N0,
        "_b_ii": nu / 2 * sp * cp,
        "_b_iii": nu / 24 * sp * F.pow(cp, 3) * (5 - tp * tp + 9 * eta2),
        "_b_iiia": nu / 720 * sp * F.pow(cp, 5) * (61 - 58 * tp * tp + F.pow(tp, 4)),
        "_b_iv": nu * cp,
        "_b_v": nu / 6 * F.pow(cp, 3) * (nu / rho - tp * tp),
        "_b_vi": nu / 120 * F.pow(cp, 5) * (5 - 18 * tp * tp + F.pow(tp, 4) + 14 * eta2 - 58 * tp * tp * eta2)})
    c = F.col
    df = _stage(df, {
        n: c("_b_i") + c("_b_ii") * dl ** 2 + c("_b_iii") * dl ** 4 + c("_b_iiia") * dl ** 6,
        e: X.NG_E0 + c("_b_iv") * dl + c("_b_v") * dl ** 3 + c("_b_vi") * dl ** 5})
    return _temp_cols(df, before, [e, n])


def with_wgs84(df: DataFrame, e: str, n: str, lat: str = "lat", lon: str = "lon",
               iterations: int = 6, datum_shift: bool = True) -> DataFrame:
    """X5 inverse: National Grid (e, n) -> WGS84 (lat, lon degrees), staged.
    datum_shift=False returns OSGB36 (Airy) latitude/longitude."""
    before = list(df.columns)
    a, b, f0 = X.AIRY_A, X.AIRY_B, X.NG_F0
    e2 = 1 - (b * b) / (a * a)
    north, east = F.col(n), F.col(e)
    df = _stage(df, {"_w_p0": F.lit(math.radians(X.NG_LAT0)) + (north - X.NG_N0) / (a * f0)})
    for k in range(iterations):
        pk = F.col(f"_w_p{k}")
        df = _stage(df, {f"_w_p{k + 1}": pk + (north - X.NG_N0 - X._meridional_arc(pk)) / (a * f0)})
    phi = F.col(f"_w_p{iterations}")
    df = _stage(df, {"_w_sp": F.sin(phi), "_w_cp": F.cos(phi), "_w_tp": F.tan(phi), "_w_de": east - X.NG_E0})
    sp, cp, tp, de = F.col("_w_sp"), F.col("_w_cp"), F.col("_w_tp"), F.col("_w_de")
    df = _stage(df, {"_w_nu": a * f0 / F.sqrt(1 - e2 * sp * sp),
                     "_w_rho": a * f0 * (1 - e2) * F.pow(1 - e2 * sp * sp, -1.5)})
    nu, rho = F.col("_w_nu"), F.col("_w_rho")
    df = _stage(df, {"_w_eta2": nu / rho - 1})
    eta2 = F.col("_w_eta2")
    df = _stage(df, {
        "_w_vii": tp / (2 * rho * nu),
        "_w_viii": tp / (24 * rho * F.pow(nu, 3)) * (5 + 3 * tp * tp + eta2 - 9 * tp * tp * eta2),
        "_w_ix": tp / (720 * rho * F.pow(nu, 5)) * (61 + 90 * tp * tp + 45 * F.pow(tp, 4)),
        "_w_x": 1 / (cp * nu),
        "_w_xi": 1 / (cp * 6 * F.pow(nu, 3)) * (nu / rho + 2 * tp * tp),
        "_w_xii": 1 / (cp * 120 * F.pow(nu, 5)) * (5 + 28 * tp * tp + 24 * F.pow(tp, 4)),
        "_w_xiia": 1 / (cp * 5040 * F.pow(nu, 7)) * (61 + 662 * tp * tp + 1320 * F.pow(tp, 4) + 720 * F.pow(tp, 6))})
    c = F.col
    df = _stage(df, {
        "_w_lat": phi - c("_w_vii") * de ** 2 + c("_w_viii") * de ** 4 - c("_w_ix") * de ** 6,
        "_w_lon": math.radians(X.NG_LON0) + c("_w_x") * de - c("_w_xi") * de ** 3 + c("_w_xii") * de ** 5
        - c("_w_xiia") * de ** 7})
    if datum_shift:
        df = _to_cart(df, "_w_lat", "_w_lon", X.AIRY_A, X.AIRY_B, "_w_c")
        df = _helmert(df, "_w_c", "_w_h", -1.0)
        df = _to_geodetic(df, "_w_h", X.GRS80_A, X.GRS80_B, "_w_la", "_w_lo")
    else:
        df = _stage(df, {"_w_la": F.col("_w_lat"), "_w_lo": F.col("_w_lon")})
    df = _stage(df, {lat: F.degrees(F.col("_w_la")), lon: F.degrees(F.col("_w_lo"))})
    return _temp_cols(df, before, [lat, lon])


def _d(v: float) -> str:
    return f"{float(v)!r}D"


def projected_ring(ring: str) -> Column:
    """X5 for every vertex of a ring of [lon, lat] (SQL text), inside the row: the steps of `with_bng` as one fold after the
    other over the ring, each adding the values that the next ones use. Gives [e, n] points; NULL for NULL."""
    a, b, f0 = X.AIRY_A, X.AIRY_B, X.NG_F0
    e2, g2 = 1 - (b * b) / (a * a), 1 - (X.GRS80_B * X.GRS80_B) / (X.GRS80_A * X.GRS80_A)
    shift = X.helmert_terms(1.0)
    arc = " + ".join(f"{_d(k)} * {term}" for k, term in zip(X.arc_terms(), ("v.d", "sin(v.d) * cos(v.s)", "sin(2 * v.d) * cos(2 * v.s)", "sin(3 * v.d) * cos(3 * v.s)"), strict=True))
    steps = [
        {"la": "radians(v[1])", "lo": "radians(v[0])"},
        {"nu": f"{_d(X.GRS80_A)} / sqrt(1 - {_d(g2)} * sin(v.la) * sin(v.la))", "la": "v.la", "lo": "v.lo"},
        {"x": "v.nu * cos(v.la) * cos(v.lo)", "y": "v.nu * cos(v.la) * sin(v.lo)", "z": f"v.nu * {_d(1 - g2)} * sin(v.la)"},
        {c: " + ".join([*(f"v.{v} * {_d(k)}" for v, k in zip("xyz", row[:3], strict=True)), _d(row[3])]) for c, row in zip("xyz", shift, strict=True)},
        {"p": "sqrt(v.x * v.x + v.y * v.y)", "z": "v.z", "lam": "atan2(v.y, v.x)", "l": f"atan2(v.z, sqrt(v.x * v.x + v.y * v.y) * {_d(1 - e2)})"},
        *[{"p": "v.p", "z": "v.z", "lam": "v.lam", "l": f"atan2(v.z + {_d(e2)} * ({_d(a)} / sqrt(1 - {_d(e2)} * sin(v.l) * sin(v.l))) * sin(v.l), v.p)"}] * 5,
        {"sp": "sin(v.l)", "cp": "cos(v.l)", "t2": "tan(v.l) * tan(v.l)", "dl": f"v.lam - {_d(math.radians(X.NG_LON0))}",
         "d": f"v.l - {_d(math.radians(X.NG_LAT0))}", "s": f"v.l + {_d(math.radians(X.NG_LAT0))}"},
        {"sp": "v.sp", "cp": "v.cp", "t2": "v.t2", "d2": "v.dl * v.dl", "dl": "v.dl", "m": arc,
         "nu": f"{_d(a * f0)} / sqrt(1 - {_d(e2)} * v.sp * v.sp)", "ratio": f"(1 - {_d(e2)} * v.sp * v.sp) / {_d(1 - e2)}"},
        {"e": f"{_d(X.NG_E0)} + v.dl * v.nu * (v.cp + v.d2 * power(v.cp, 3) / 6 * (v.ratio - v.t2) + v.d2 * v.d2 * power(v.cp, 5) / 120 * "
              "(5 - 18 * v.t2 + v.t2 * v.t2 + 14 * (v.ratio - 1) - 58 * v.t2 * (v.ratio - 1)))",
         "n": f"{_d(X.NG_N0)} + v.m + v.d2 * v.nu * v.sp * (v.cp / 2 + v.d2 * power(v.cp, 3) / 24 * (5 - v.t2 + 9 * (v.ratio - 1)) + "
              "v.d2 * v.d2 * power(v.cp, 5) / 720 * (61 - 58 * v.t2 + v.t2 * v.t2))"},
    ]
    out = ring
    for step in steps:
        out = f"transform({out}, v -> named_struct({', '.join(f'{name!r}, {value}' for name, value in step.items())}))"
    return F.expr(f"transform({out}, v -> array(v.e, v.n))")


def with_area_centroid_bng(df: DataFrame, ring: str, lat: str, lon: str) -> DataFrame:
    """Area-weighted centroid computed in the National Grid, returned on WGS84. All of it is arithmetic inside
    the row: the vertices are neither exploded nor shuffled, and nothing runs while the query is built."""
    own = [c for c in df.columns if c not in (lat, lon)]
    df = with_area_centroid(df.withColumn("_pring", projected_ring(f"`{ring}`")), "_pring", "_ce", "_cn")
    return with_wgs84(df, "_ce", "_cn", lat, lon).select(*[F.col(f"`{c}`") for c in own], lat, lon)
