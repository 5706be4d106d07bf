"""Layer 2 and 3: unit vectors and invariants for operators whose oracle is not SQL,
and edge cases the fixture views do not plant."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from civiclens.functions import geo as X
from civiclens.functions.lists import parse_double_list, parse_int_list, primary_topic, unordered_pairs
from civiclens.functions.scalar import percent, row_sum, sign_class
from civiclens.functions.stats import student_t_two_sided_p
from civiclens.operators import geometry as GM
from civiclens.operators import histograms as H
from civiclens.operators import quantiles as Q
from civiclens.operators import regression as R
from civiclens.operators.spatial import spatial_join
from civiclens.sources.readers import read_geojson


# -- statistics helpers ------------------------------------------------------------------
@pytest.mark.parametrize("t", [0.0, 0.5, 1.0, 2.5, 10.0])
def test_student_t_closed_forms(t):
    assert student_t_two_sided_p(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(abs(t)), abs=1e-12)
    assert student_t_two_sided_p(t, 2) == pytest.approx(1 - abs(t) / math.sqrt(t * t + 2), abs=1e-12)


def test_student_t_large_df_tends_to_normal():
    # two-sided normal tail at 1.96 is 0.0499958
    assert student_t_two_sided_p(1.959963984540054, 1e7) == pytest.approx(0.05, abs=1e-6)


def _np_percentile(xs, q):
    xs = sorted(xs)
    pos = q * (len(xs) - 1)
    lo, hi = math.floor(pos), math.ceil(pos)
    return xs[lo] + (xs[hi] - xs[lo]) * (pos - lo)


def test_exact_quantiles_with_hot_group(spark):
    rnd = random.Random(7)
    rows = [("hot", rnd.random()) for _ in range(3000)] + [(f"g{i % 7}", rnd.gauss(0, 1)) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = {r["g"]: r for r in Q.exact_quantiles(df, "x", ["g"], [0.1, 0.5, 0.95], ["a", "b", "c"]).collect()}
    for g in {r[0] for r in rows}:
        xs = [x for gg, x in rows if gg == g]
        assert out[g]["n"] == len(xs)
        for name, q in (("a", 0.1), ("b", 0.5), ("c", 0.95)):
            assert out[g][name] == pytest.approx(_np_percentile(xs, q), abs=1e-12)


def _box_ref(xs, whis=1.5):
    q1, med, q3 = (_np_percentile(xs, q) for q in (0.25, 0.5, 0.75))
    iqr = q3 - q1
    hi = [x for x in xs if x <= q3 + whis * iqr]
    lo = [x for x in xs if x >= q1 - whis * iqr]
    whishi = q3 if not hi or max(hi) < q3 else max(hi)
    whislo = q1 if not lo or min(lo) > q1 else min(lo)
    fl = sum(1 for x in xs if x < whislo or x > whishi)
    return q1, med, q3, whislo, whishi, fl


def test_box_stats_matches_matplotlib_rules(spark):
    data = {"a": [1, 2, 3, 4, 5, 6, 7, 8, 100, -50], "b": [5.0, 5.0, 5.0], "c": [0.0, 1.0]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double")
    out = {r["k"]: r for r in Q.box_stats(df, "v", ["k"]).collect()}
    for k, xs in data.items():
        q1, med, q3, wl, wh, fl = _box_ref([float(x) for x in xs])
        r = out[k]
        assert (r["q1"], r["median"], r["q3"], r["whislo"], r["whishi"], r["n_fliers"]) == \
            pytest.approx((q1, med, q3, wl, wh, fl))


# -- histograms ----------------------------------------------------------------------------
def test_histogram_last_bin_closed_and_counts_sum(spark):
    df = spark.createDataFrame([(None if x is None else float(x),) for x in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]], "x double")
    h = {r["bin"]: r["n"] for r in H.histogram(df, "x", 5).collect()}
    assert sum(h.values()) == 11
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}   # 10 (the max) lands in the last bin


def test_histogram_constant_input_widens(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    rows = H.histogram(df, "x", 4).orderBy("bin").collect()
    assert rows[0]["bin_lo"] == 2.5 and rows[-1]["bin_hi"] == 3.5
    assert sum(r["n"] for r in rows) == 2


def test_histogram_fixed_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (19.95,), (20.0,), (20.01,), (-0.1,)], "x double")
    h = {r["bin"]: r["n"] for r in H.histogram_fixed(df, "x", 0.1, 20.0).collect() if r["n"]}
    assert h == {0: 1, 2: 1, 199: 2}   # 0.3 < 3 * 0.1 in floating point; 20.0 closes the last bin


# -- lists -----------------------------------------------------------------------------------
def test_list_literals(spark):
    df = spark.createDataFrame([("[1, -1, 22]",), ("[1, None]",), ("(1, 2)",), ("3",), ("[1.0, 2]",),
                                (None,), ("[]",)], "t string")
    out = [r["a"] for r in df.select(parse_int_list("t").alias("a")).collect()]
    assert out[0] == [1, -1, 22]
    assert out[1] == [1, None]
    assert out[2] == [1, 2]
    assert out[3] is None and out[5] is None
    assert out[6] == []
    empty = df.select(parse_int_list("t", missing_as_empty=True).alias("a")).collect()[5]["a"]
    assert empty == []


def test_probability_literal_nan(spark):
    df = spark.createDataFrame([("[0.5, nan, 0.25]",)], "t string")
    assert df.select(parse_double_list("t").alias("a")).first()["a"] == [0.5, 0.0, 0.25]


def test_primary_topic_skips_outliers_and_zero(spark):
    df = spark.createDataFrame([([-1, 0, 4, 2],), ([-1, 0],), ([],)], "a array<int>")
    assert [r["p"] for r in df.select(primary_topic("a").alias("p")).collect()] == [4, None, None]


def test_unordered_pairs(spark):
    df = spark.createDataFrame([([3, 1, 2, 5],)], "a array<int>")
    pairs = df.select(unordered_pairs("a").alias("p")).first()["p"]
    assert sorted((p["a"], p["b"]) for p in pairs) == [(1, 2), (1, 3), (1, 5), (2, 3), (2, 5), (3, 5)]


def test_scalars(spark):
    df = spark.createDataFrame([(None, None, 0, -0.5), (2, 3, 4, 0.0), (1, None, 0, 0.25)],
                               "a int, b int, w int, s double")
    rows = df.select(row_sum(["a", "b"]).alias("rs"), percent("a", "w").alias("p"),
                     sign_class("s").alias("c")).collect()
    assert [r["rs"] for r in rows] == [0, 5, 1]
    assert [r["p"] for r in rows] == [None, 50.0, None]
    assert [r["c"] for r in rows] == ["Negative", "Neutral", "Positive"]


# -- geometry ------------------------------------------------------------------------------
def _hav(lat1, lon1, lat2, lon2):
    p1, p2 = math.radians(lat1), math.radians(lat2)
    a = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6371.0 * 2 * math.asin(math.sqrt(a))


def test_haversine(spark):
    df = spark.createDataFrame([(51.5074, -0.1278, 48.8566, 2.3522), (51.5, None, 51.5, 0.0)],
                               "a double, b double, c double, d double")
    out = [r["d"] for r in df.select(X.haversine_km("a", "b", "c", "d").alias("d")).collect()]
    assert out[0] == pytest.approx(_hav(51.5074, -0.1278, 48.8566, 2.3522), rel=1e-12)
    assert out[1] is None   # a missing coordinate stays missing (no `least` NULL skipping)


def test_centroids(spark):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    df = spark.createDataFrame([(ring,)], "r array<array<double>>")
    c = GM.with_area_centroid(df, "r", "x", "y", "area").first()
    assert (c["x"], c["y"], abs(c["area"])) == pytest.approx((2.0, 1.0, 8.0))
    v = GM.with_vertex_mean(df, "r", "lat", "lon").first()
    assert (v["lat"], v["lon"]) == pytest.approx((0.8, 1.6))   # closing vertex counted twice


def test_multipart_centroid_with_hole(spark):
    shell = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
    hole = [[0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [2.0, 0.0], [0.0, 0.0]]       # same winding as the shell
    other = [[10.0, 0.0], [12.0, 0.0], [12.0, 2.0], [10.0, 2.0], [10.0, 0.0]]
    df = spark.createDataFrame([([[shell, hole], [other]],)], "p array<array<array<array<double>>>>")
    c = df.select(X.parts_area_centroid("p").alias("c")).first()["c"]
    # shell 16 at (2,2) minus hole 4 at (1,1) plus 4 at (11,1): (32 - 4 + 44) / 16, (32 - 4 + 4) / 16
    assert (c["x"], c["y"], c["area"]) == pytest.approx((4.5, 2.0, 16.0))


def test_descriptive_report_with_boundaries(spark, tmp_path):
    from civiclens.plans import reports as Rp
    from civiclens.sources.fixtures import fixtures
    from tests.conftest import SF_SMALL
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"LAD24NM": f"NATION_{k}"},
         "geometry": {"type": "MultiPolygon" if k % 2 else "Polygon",
                      "coordinates": ([[ring]] if k % 2 else [ring])}}
        for k, ring in ((k, [[k, 0], [k + 1, 0], [k + 1, 1], [k, 1], [k, 0]]) for k in range(6))]}
    p = tmp_path / "lad.geojson"
    p.write_text(json.dumps(fc))
    i = Rp.Inputs.from_fixtures(fixtures(spark, SF_SMALL))
    i.lad = read_geojson(spark, str(p), ["LAD24NM"])
    out = Rp.descriptive_report(i)
    labels = {r["LAD24NM"]: r for r in out["lad_labels"].collect()}
    assert len(labels) == 6 and labels["NATION_2"]["centroid_x"] == pytest.approx(2.5)
    assert {r["side"] for r in labels.values()} <= {"left", "right", "top", "bottom"}


def test_ring_validity(spark):
    df = spark.createDataFrame([([[0.0, 0.0], [1.0, 0.0]],), ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]],),
                                ([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]],)], "r array<array<double>>")
    assert [r["v"] for r in df.select(X.ring_is_valid("r").alias("v")).collect()] == [False, True, False]


def test_national_grid_vector(spark):
    # Ordnance Survey worked example (Airy ellipsoid, no datum shift):
    # 52 deg 39' 27.2531" N, 1 deg 43' 4.5177" E -> E 651409.903, N 313177.270.
    lat = 52 + 39 / 60 + 27.2531 / 3600
    lon = 1 + 43 / 60 + 4.5177 / 3600
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    en = GM.with_bng(df, "lat", "lon", "e", "n", datum_shift=False).first()
    assert en["e"] == pytest.approx(651409.903, abs=1e-3)
    assert en["n"] == pytest.approx(313177.270, abs=1e-3)
    plain = GM.with_wgs84(GM.with_bng(df, "lat", "lon", "e", "n", datum_shift=False), "e", "n", "lat2", "lon2",
                          datum_shift=False).first()
    assert plain["lat2"] == pytest.approx(lat, abs=1e-8) and plain["lon2"] == pytest.approx(lon, abs=1e-8)
    # With the datum shift the inverse Helmert (negated parameters) is good to a few mm.
    back = GM.with_wgs84(GM.with_bng(df, "lat", "lon", "e", "n"), "e", "n", "lat2", "lon2").first()
    assert back["lat2"] == pytest.approx(lat, abs=1e-7) and back["lon2"] == pytest.approx(lon, abs=1e-7)


def test_bng_centroid_close_to_planar(spark):
    ring = [[-0.1, 51.5], [-0.098, 51.5], [-0.098, 51.5012], [-0.1, 51.5012], [-0.1, 51.5]]
    df = spark.createDataFrame([("a", ring)], "k string, r array<array<double>>")
    c = GM.with_area_centroid_bng(df, "r", "lat", "lon").first()
    assert c["lat"] == pytest.approx(51.5006, abs=1e-6) and c["lon"] == pytest.approx(-0.099, abs=1e-6)


# -- spatial join ----------------------------------------------------------------------------
def _inside(px, py, rings):
    c = 0
    for ring in rings:
        n = len(ring)
        for i in range(n):
            (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % n]
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                c += 1
    return c % 2 == 1


def test_spatial_join_hole_multipart_concave(spark):
    polys = {
        "A_hole": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[3, 3], [7, 3], [7, 7], [3, 7], [3, 3]]],
        "B_multi": [[[20, 0], [24, 0], [24, 4], [20, 4]], [[30, 0], [34, 0], [34, 4], [30, 4]]],
        "C_concave": [[[40, 0], [50, 0], [50, 10], [45, 3], [40, 10], [40, 0]]],
    }
    pdf = spark.createDataFrame([(k, [[[float(a), float(b)] for a, b in r] for r in rings]) for k, rings in polys.items()],
                                "code string, rings array<array<array<double>>>")
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-2, 52), rnd.uniform(-2, 12)) for i in range(3000)] + [(9999, None, 5.0)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    out = {r["id"]: r["code"] for r in spatial_join(df, pdf, x="x", y="y", code="code", rings="rings").collect()}
    assert len(out) == len(pts)   # one row per point
    for i, x, y in pts:
        want = None if x is None else min((k for k, rings in polys.items() if _inside(x, y, rings)), default=None)
        assert out[i] == want, (i, x, y)


def test_spatial_join_strict_excludes_boundary(spark):
    pdf = spark.createDataFrame([("L", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]]),
                                 ("R", [[[1.0, 0.0], [2.0, 0.0], [2.0, 1.0], [1.0, 1.0]]])],
                                "code string, rings array<array<array<double>>>")
    pts = spark.createDataFrame([(1, 1.0, 0.5), (2, 0.5, 0.5), (3, 1.5, 0.25)], "id long, x double, y double")
    loose = {r["id"]: r["code"] for r in spatial_join(pts, pdf, x="x", y="y", code="code", strict=False).collect()}
    strict = {r["id"]: r["code"] for r in spatial_join(pts, pdf, x="x", y="y", code="code").collect()}
    assert loose[1] in ("L", "R") and strict[1] is None      # on the shared edge
    assert loose[2] == strict[2] == "L" and loose[3] == strict[3] == "R"


def test_approx_quantiles_close_to_exact(spark):
    rnd = random.Random(11)
    df = spark.createDataFrame([("g", rnd.random()) for _ in range(5000)], "g string, x double")
    ex = Q.exact_quantiles(df, "x", ["g"], [0.5], ["m"]).first()["m"]
    ap = Q.exact_quantiles(df, "x", ["g"], [0.5], ["m"], accuracy=10000).first()["m"]
    assert abs(ex - ap) < 0.01


def test_read_geojson_polygon_and_multipolygon(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"LSOA21CD": "E1"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
        {"type": "Feature", "properties": {"LSOA21CD": "E2"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[[[2, 0], [3, 0], [3, 1], [2, 0]]],
                                                              [[[4, 0], [5, 0], [5, 1], [4, 0]]]]}}]}
    p = tmp_path / "b.geojson"
    p.write_text(json.dumps(fc))
    rows = {r["LSOA21CD"]: r for r in read_geojson(spark, str(p), ["LSOA21CD"]).collect()}
    assert len(rows["E1"]["parts"]) == 1 and len(rows["E2"]["parts"]) == 2
    assert rows["E2"]["parts"][1][0][1] == [5.0, 0.0]


# -- regression ---------------------------------------------------------------------------
def test_ols_and_pearson(spark):
    rows = [(float(x), 2.0 * x + 1 + (0.5 if x % 2 else -0.5)) for x in range(10)] + [(None, 3.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    fit = R.ols(df, "x", "y").first()
    assert fit["n_fit"] == 10 and fit["slope"] == pytest.approx(2.0, abs=0.1)
    pr = R.pearson(df, "x", "y", with_p=True).first()
    assert pr["n"] == 10 and 0.99 < pr["r"] < 1 and pr["p"] < 1e-6
    const = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert R.pearson(const, "x", "y").first()["r"] is None   # no ANSI divide-by-zero


def test_welch_matches_formula(spark):
    a = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    b = [2.0, 4.0, 9.0]
    da = spark.createDataFrame([(x,) for x in a], "v double")
    db = spark.createDataFrame([(x,) for x in b], "v double")
    w = R.welch_t(da, db, "v", with_p=True).first()
    ma, mb = sum(a) / 6, sum(b) / 3
    va = sum((x - ma) ** 2 for x in a) / 5
    vb = sum((x - mb) ** 2 for x in b) / 2
    t = (ma - mb) / math.sqrt(va / 6 + vb / 3)
    dof = (va / 6 + vb / 3) ** 2 / ((va / 6) ** 2 / 5 + (vb / 3) ** 2 / 2)
    assert w["t"] == pytest.approx(t, abs=1e-6) and w["df"] == pytest.approx(dof, abs=1e-6)
    assert 0 < w["p"] < 1


def test_bootstrap_band_is_repeatable(spark):
    rnd = random.Random(1)
    rows = [("g", float(x), 3.0 * x + rnd.gauss(0, 5)) for x in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    a = R.regression_band(df, "x", "y", "g", replicates=200, grid=20).orderBy("grid_index").collect()
    b = R.regression_band(df, "x", "y", "g", replicates=200, grid=20).orderBy("grid_index").collect()
    assert a == b and len(a) == 20
    assert all(r["lo"] <= r["yhat"] <= r["hi"] for r in a)


def test_kde_integrates_to_one(spark):
    rnd = random.Random(5)
    df = spark.createDataFrame([("s", rnd.gauss(0, 1)) for _ in range(2000)], "g string, x double")
    rows = H.kde_1d(df, "x", "g", gridsize=200).orderBy("grid_index").collect()
    step = rows[1]["x"] - rows[0]["x"]
    area = sum(r["density"] for r in rows) * step
    assert 0.9 < area < 1.0   # support cut at the data range, as the plot does


# -- aggregates edge cases --------------------------------------------------------------------
def test_top_n_other_emits_empty_other_slice(spark):
    from civiclens.operators.aggregates import top_n_other
    from civiclens.sources.readers import normalise_topic_names
    names = normalise_topic_names(spark.createDataFrame(
        [(1, 5, "a", "#1"), (2, 9, "b", "#2"), (3, 1, "c", "#3")], "Topic int, Count long, topic_group string, color string"))
    rows = {r["slice"]: r for r in top_n_other(names, n=20).collect()}
    assert sorted(rows) == [0, 1, 2, 20]
    assert rows[0]["topic_id"] == 2 and rows[20]["topic_count"] == 0 and rows[20]["topic_group"] == "other"
    assert sum(r["share"] for r in rows.values()) == pytest.approx(100.0)


def test_stance_by_council_ignores_unlisted_stances_and_null_council(spark):
    from civiclens.operators.aggregates import stance_by_council
    df = spark.createDataFrame([("A", "Supports"), ("A", "Objects"), ("A", "Objects"), ("A", "Unclear"),
                                (None, "Supports"), ("B", "Unclear")], "council string, stance string")
    rows = {r["council"]: r for r in stance_by_council(df).collect()}
    assert set(rows) == {"A", "B"}     # the null council is dropped
    assert tuple(rows["B"])[1:] == (0, 0, 0, None, None, None)
    a = rows["A"]
    assert (a["supports"], a["objects"], a["neutral"]) == (1, 2, 0)
    assert a["pct_objects"] == pytest.approx(200 / 3, abs=1e-6)


def test_composite_key_is_null_when_a_part_is_null(spark):
    from civiclens.functions.scalar import composite_key
    df = spark.createDataFrame([("A1", "X"), ("A1", None)], "a string, b string")
    assert [r["k"] for r in df.select(composite_key("a", "b").alias("k")).collect()] == ["A1_X", None]


def test_bootstrap_band_matches_a_row_bootstrap(spark):
    """Half of all rows are equal, which is where drawing equal rows together would widen the band."""
    import numpy as np
    from civiclens.operators.regression import regression_band
    rng = np.random.default_rng(8)
    x = np.concatenate([np.ones(300), rng.integers(1, 40, 280), np.full(20, 60)]).astype(float)
    y = np.concatenate([np.zeros(300), rng.poisson(4, 300)]).astype(float)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y)], "g string, x double, y double")
    got = sorted((r["grid_index"], r["hi"] - r["lo"]) for r in regression_band(df, "x", "y", "g", replicates=800, grid=12).collect())
    grid, lines = np.linspace(x.min(), x.max(), 12), []
    for _ in range(800):
        pick = rng.integers(0, len(x), len(x))
        lines.append(np.polyval(np.polyfit(x[pick], y[pick], 1), grid))
    lo, hi = np.percentile(lines, [2.5, 97.5], axis=0)
    assert np.mean([w for _, w in got] / (hi - lo)) == pytest.approx(1, abs=0.1)


def test_poisson_weights_have_the_right_moments():
    import numpy as np
    from civiclens.operators.regression import bootstrap_weights
    x, replicates = np.arange(300) * 1.5 - 7, np.arange(500)
    for count in (1, 5, 16, 17, 300):
        w = bootstrap_weights(x, x % 7, np.full(300, count), replicates, 0)
        assert w.mean() == pytest.approx(count, rel=0.01) and w.var() == pytest.approx(count, rel=0.03)
        off = np.corrcoef(w)[np.triu_indices(300, 1)]
        assert abs(off.mean()) < 0.005 and off.std() == pytest.approx(500**-0.5, rel=0.05)   # pairs are drawn apart
    assert (bootstrap_weights(x, x, np.full(300, 2), replicates, 0) != bootstrap_weights(x, x, np.full(300, 2), replicates, 1)).any()


def test_bootstrap_band_edges(spark):
    """Null and NaN rows are skipped, a group with one x has no line; no rows for pairs and replicates in the plan."""
    rows = [("g", float(k % 20), 2.0 * (k % 20) + k % 3) for k in range(400)] + [("one", 5.0, float(k)) for k in range(9)]
    rows += [("g", None, 1.0), ("g", float("nan"), 1.0), ("g", 3.0, None), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    band = R.regression_band(df, "x", "y", "g", replicates=100, grid=5)
    got = band.collect()
    assert {r["g"] for r in got} == {"g"} and len(got) == 5
    assert "explode(sequence(0, 99" not in band._jdf.queryExecution().optimizedPlan().toString()
    assert R.regression_band(df.where("false"), "x", "y", "g", replicates=10, grid=5).count() == 0


def test_bng_centroid_of_rows_with_equal_keys(spark):
    from civiclens.operators import geometry as GM
    square = lambda x, y: [[x, y], [x + 0.01, y], [x + 0.01, y + 0.01], [x, y + 0.01], [x, y]]
    df = spark.createDataFrame([("k", square(0.0, 51.0)), ("k", square(0.5, 52.0)), ("k", None)], "k string, r array<array<double>>")
    got = sorted((r["lat"], r["lon"]) for r in GM.with_area_centroid_bng(df, "r", "lat", "lon").collect() if r["lat"] is not None)
    assert got == [(pytest.approx(51.005, abs=1e-4), pytest.approx(0.005, abs=1e-4)), (pytest.approx(52.005, abs=1e-4), pytest.approx(0.505, abs=1e-4))]


def test_csv_is_read_by_name_with_reject_counts(spark, tmp_path):
    from civiclens.sources.readers import read_census, read_comment_topics, read_comments, reject_count
    f = tmp_path / "c.csv"
    f.write_text('text,lon,lat,council,application_id,comment_id,stance,sentiment_score\n'
                 '"hello, ""you""\nthere",-0.5,51.5,Camden,APP1,7,Objects,nan\nx,oops,,Brent,APP2,eight,Supports,0.25\n')
    rows = sorted(read_comments(spark, str(f)).collect(), key=lambda r: r["application_id"])
    assert tuple(rows[0]) == (7, "APP1", "Camden", "Objects", None, 51.5, -0.5)
    assert tuple(rows[1]) == (None, "APP2", "Brent", "Supports", 0.25, None, None)
    assert tuple(reject_count(read_comments(spark, str(f), rejects=True)).first()) == (2, 1)
    with pytest.raises(Exception, match="topic_number"):
        read_comment_topics(spark, str(f)).collect()
    g = tmp_path / "t.csv"
    g.write_text('LSOA name,LSOA code,All Households,Owned outright\nA,E1,"1,200",30\n')
    r = read_census(spark, str(g), ["All Households", "Owned outright"]).first()
    assert tuple(r) == ("E1", 1200, 30)


def test_within_leaves_boundary_points_unmatched(spark):
    from civiclens.operators.spatial import spatial_join
    square = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]
    polys = spark.createDataFrame([("s", square)], "code string, rings array<array<array<double>>>")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.0, 0.5), (3, 1.0, 1.0), (4, None, 0.5)], "id int, lon double, lat double")
    got = {r["id"]: r["code"] for r in spatial_join(pts, polys).collect()}
    assert got == {1: "s", 2: None, 3: None, 4: None}


def test_binned_density_keeps_its_error_bound(spark):
    rnd = random.Random(12)
    rows = [("a", rnd.gauss(0, 1)) for _ in range(3000)] + [("a", 0.25)] * 1500 + [("b", rnd.uniform(-2, 4)) for _ in range(500)] + [("one", 1.0)] * 5 + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    exact = {(r["g"], r["grid_index"]): r for r in H.kde_1d(df, "x", "g", gridsize=50, digits=15).collect()}
    for bins in (32, 256, 4096):
        got = H.kde_binned(df, "x", "g", gridsize=50, bins=bins, digits=15).collect()
        assert {(r["g"], r["grid_index"]) for r in got} == set(exact) and {r["g"] for r in got} == {"a", "b"}
        for r in got:
            want = exact[r["g"], r["grid_index"]]
            assert abs(r["density"] - want["density"]) <= r["error"] + 1e-12 and r["x"] == pytest.approx(want["x"])
    assert max(r["error"] for r in got) < 1e-4
    assert H.kde_binned(df.where("x = 1"), "x", "g").count() == H.kde_binned(df.where("false"), "x", "g").count() == 0


def test_centroids_without_area(spark):
    """A line gives the centroid of its boundary, a single point itself; nothing is lost."""
    line = [[0.0, 0.0], [4.0, 0.0], [4.0, 0.0], [1.0, 0.0], [0.0, 0.0]]
    bent = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 0.0]]
    point = [[3.0, 1.0]] * 4
    df = spark.createDataFrame([("line", line), ("bent", bent), ("point", point), ("short", [[1.0, 1.0], [2.0, 2.0]]), ("none", None)], "k string, r array<array<double>>")
    got = {r["k"]: (r["x"], r["y"], r["area"]) for r in GM.with_area_centroid(df, "r", "x", "y", "area").collect()}
    assert got == {"line": (2.0, 0.0, 0.0), "bent": (1.5, 0.5, 0.0), "point": (3.0, 1.0, 0.0), "short": (None,) * 3, "none": (None,) * 3}
    parts = spark.createDataFrame([("lines", [[line], [[[10.0, 0.0], [12.0, 0.0], [12.0, 0.0]]]]), ("points", [[point], [[[5.0, 5.0]] * 3]]),
                                   ("mixed", [[line], [[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]]), ("none", [])], "k string, p array<array<array<array<double>>>>")
    got = {r["k"]: tuple(r["c"]) for r in parts.select("k", X.parts_area_centroid("p").alias("c")).collect()}
    # lengths 8 at x = 2 and 4 at x = 11
    assert got == {"lines": (5.0, 0.0, 0.0), "points": (4.0, 3.0, 0.0), "mixed": (1.0, 1.0, 4.0), "none": (None, None, None)}
