"""GeoJSON features by byte ranges: equal to the whole read for any place of the splits."""

import json
import random

import pytest

from civiclens.sources import split_json
from civiclens.sources.readers import geojson_crs, read_geojson

TEXTS = ["plain", 'a "quoted" name', "back\\slash", "ends with \\", "{not} [a] }bracket{", "line\nfeed", "é日本😀", "", '\\"}', "}" * 9, "{" * 9, '"' * 5, None]


def feature(rng, i):
    ring = lambda n: [[rng.uniform(-1, 1), rng.uniform(50, 52)] for _ in range(n)]
    kind = rng.choice(["Polygon", "Polygon", "MultiPolygon", "Point", None])
    geometry = None if kind is None else {"type": kind, "coordinates": {"Polygon": [ring(rng.randint(3, 20)), ring(4)], "MultiPolygon": [[ring(4)], [ring(rng.randint(3, 9)), ring(3)]],
                                                                       "Point": [0.5, 51.5]}[kind]}
    return {"type": "Feature", "id": i, "properties": {"code": f"E{i}", "name": rng.choice(TEXTS), "deep": {"more": [{"x": "}"}]}}, "geometry": geometry}


def collection(features, crs=None, after=False):
    out = {"type": "FeatureCollection", "name": 'n{"}', **({"crs": {"type": "name", "properties": {"name": crs}}} if crs else {}), "features": features}
    return out | ({"bbox": [1, 2, 3, 4], "more": [{"type": "Other", "properties": {"code": "no"}}]} if after else {})


def rows(df):
    return sorted((repr(tuple(r)) for r in df.collect()))


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


@pytest.mark.parametrize("kw", [{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_equal_to_the_whole_read(spark, tmp_path, small_splits, kw):
    rng = random.Random(1)
    path = str(tmp_path / "a.geojson")
    (tmp_path / "a.geojson").write_text(json.dumps(collection([feature(rng, i) for i in range(120)], "urn:ogc:def:crs:OGC:1.3:CRS84", after=True), **kw))
    assert split_json.splits(spark, path).count() > 20
    got = read_geojson(spark, path, ["code", "name"])
    assert rows(got) == rows(read_geojson(spark, path, ["code", "name"], split=False)) and got.count() == 120


def test_features_over_many_splits_and_more_files(spark, tmp_path, small_splits):
    rng = random.Random(2)
    long = [[i / 1000, 51 + i / 1000] for i in range(900)]
    big = {"type": "Feature", "properties": {"code": "big"}, "geometry": {"type": "Polygon", "coordinates": [long]}}
    for k in range(3):
        features = [feature(rng, 10 * k), big, big, feature(rng, 10 * k + 1)][: 4 - k]
        (tmp_path / f"{k}.geojson").write_text(json.dumps(collection(features)) + "\n" * k)
    (tmp_path / "none.geojson").write_text(json.dumps(collection([])))
    got = read_geojson(spark, str(tmp_path), ["code"])
    assert rows(got) == rows(read_geojson(spark, str(tmp_path), ["code"], split=False))
    assert [len(r["parts"][0][0]) for r in got.collect() if r["code"] == "big"] == [900] * 5


def test_a_hundred_thousand_features_in_several_tasks(spark, tmp_path):
    rng = random.Random(3)
    path = str(tmp_path / "a.geojson")
    some = [json.dumps(feature(rng, i)) for i in range(1000)]
    (tmp_path / "a.geojson").write_text('{"type": "FeatureCollection", "features": [' + ", ".join(some * 100) + "]}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        got = read_geojson(spark, path, ["code"])
        assert split_json.splits(spark, path).count() > 8
        assert got.count() == 100_000 and got.select("code").distinct().count() == 1000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_reference_system_of_the_file(spark, tmp_path):
    for name, crs in (("urn:ogc:def:crs:EPSG::27700", "EPSG:27700"), ("EPSG:3857", "EPSG:3857"), ("urn:ogc:def:crs:OGC:1.3:CRS84", "EPSG:4326"), (None, "EPSG:4326")):
        (tmp_path / "a.geojson").write_text(json.dumps(collection([feature(random.Random(0), 0)], name)))
        assert geojson_crs(spark, str(tmp_path / "a.geojson")) == crs
        assert read_geojson(spark, str(tmp_path / "a.geojson"), ["code"]).schema["parts"].metadata == {"crs": crs}
    assert read_geojson(spark, str(tmp_path / "a.geojson"), ["code"], crs="EPSG:27700").schema["parts"].metadata == {"crs": "EPSG:27700"}


def square(lon, lat, size=0.01):
    return [[lon, lat], [lon + size, lat], [lon + size, lat + size], [lon, lat + size], [lon, lat]]


def test_boundaries_in_national_grid_give_the_codes_of_wgs84(spark, tmp_path):
    """The demographic report on files as `read_geojson` reads them, in both reference systems."""
    from civiclens.operators.geometry import with_bng
    from civiclens.plans import reports as Rp
    from civiclens.sources.fixtures import fixtures
    from tests.conftest import SF_SMALL

    codes = {f"E{i}{j}": square(-0.2 + 0.01 * i, 51.4 + 0.01 * j) for i in range(6) for j in range(6)}
    corners = spark.createDataFrame([(c, k, *p) for c, ring in codes.items() for k, p in enumerate(ring)], "code string, k int, lon double, lat double")
    grid = {}
    for r in sorted(with_bng(corners, "lat", "lon").collect(), key=lambda r: (r["code"], r["k"])):
        grid.setdefault(r["code"], []).append([r["bng_e"], r["bng_n"]])
    rng = random.Random(4)
    points = [(n, -0.2 + 0.01 * i + rng.uniform(0.001, 0.009), 51.4 + 0.01 * j + rng.uniform(0.001, 0.009)) for n, (i, j) in enumerate((i, j) for i in range(-1, 7) for j in range(-1, 7))]
    comments = spark.createDataFrame([*points, (999, None, 51.4)], "comment_id long, lon double, lat double")
    census = [spark.createDataFrame([(c, 100, 20, 10) for c in codes], f"`LSOA code` string, `{whole}` long, {a} long, {b} long") for whole, a, b in (
        ("All usual residents", "age_50_69", "age_70_plus"), ("All usual residents aged 16 and over in employment", "occupation_1", "occupation_2_3"),
        ("All Households", "owned_outright", "owned_mortgage"))]
    got = {}
    for name, rings in (("EPSG:4326", codes), ("EPSG:27700", grid)):
        path = tmp_path / f"{name[5:]}.geojson"
        path.write_text(json.dumps(collection([{"type": "Feature", "properties": {"LSOA21CD": c}, "geometry": {"type": "Polygon", "coordinates": [ring]}}
                                               for c, ring in rings.items()], f"urn:ogc:def:crs:EPSG::{name[5:]}")))
        inputs = Rp.Inputs.from_fixtures(fixtures(spark, SF_SMALL))
        inputs.comments, inputs.lsoa = comments, read_geojson(spark, str(path), ["LSOA21CD"])
        inputs.census_age, inputs.census_occupation, inputs.census_tenure = census
        report = Rp.demographic_report(inputs)
        got[name] = {r["comment_id"]: r["lsoa_code"] for r in report["comment_lsoa"].collect()}
        assert report["lsoa_profile"].count() == 36
    want = {n: next((c for c, ring in codes.items() if ring[0][0] < x < ring[2][0] and ring[0][1] < y < ring[2][1]), None) for n, x, y in points}
    assert got["EPSG:4326"] == got["EPSG:27700"] == {**want, 999: None} and len(set(want.values())) == 37
