"""The adaptive cells of the spatial join: against brute force, with cuts forced at every level."""

import math
import random

import pytest
from pyspark.sql import functions as F

from civiclens.operators.spatial import polygon_cells, spatial_join

POLYGONS = "code string, rings array<array<array<double>>>"


def inside(px, py, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], *ring[:1]], strict=True):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rnd, x, y, r, n):
    turns = sorted(rnd.uniform(0, 2 * math.pi) for _ in range(n))
    return [[x + r * rnd.uniform(0.2, 1) * math.cos(t), y + r * rnd.uniform(0.2, 1) * math.sin(t)] for t in turns]


def join(spark, points, polygons, **kw):
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, lon double, lat double")
    rows = spatial_join(pts, spark.createDataFrame(polygons, POLYGONS) if isinstance(polygons, list) else polygons, **kw).collect()
    assert len(rows) == len(points) and set(rows[0].asDict()) == {"id", "lon", "lat", "code"}
    return {r["id"]: r["code"] for r in rows}


@pytest.mark.parametrize("kw", [{}, {"most_edges": 1, "cell_size": 40.0}, {"cell_size": 0.37, "most_edges": 20}])
def test_cells_equal_brute_force(spark, monkeypatch, kw):
    monkeypatch.setattr("civiclens.operators.spatial.MOST_CUT", 10**9)
    rnd = random.Random(5)
    polygons = [(f"s{k:02}", [star(rnd, rnd.uniform(-9, 9), rnd.uniform(-9, 9), rnd.choice([0.05, 0.5, 3, 9]), rnd.randint(3, 60)) for _ in range(rnd.randint(1, 3))]) for k in range(40)]
    polygons += [("grid", [[[0.0, 0.0], [8.0, 0.0], [8.0, 8.0], [0.0, 8.0], [0.0, 0.0]], [[2.0, 2.0], [4.0, 2.0], [4.0, 4.0], [2.0, 4.0]]]),
                 ("point", [[[1.0, 1.0], [1.0, 1.0], [1.0, 1.0]]]), ("none", []), ("empty", [[]]), (None, [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]]])]
    points = [(rnd.uniform(-12, 12), rnd.uniform(-12, 12)) for _ in range(3000)] + [(float(a), float(b)) for a in range(-2, 10) for b in range(-2, 10)]
    got = join(spark, points, polygons, strict=False, **kw)
    for i, p in enumerate(points):
        assert got[i] == min((c for c, rings in polygons if c and inside(*p, rings)), default=None), (i, p)


def test_many_polygons_in_one_cell(spark):
    """10,000 small polygons in one cell of the median polygon's size: no row of the cell table over 1 MB."""
    n, side = 100, 0.01
    ring = lambda x0, y0, x1, y1: f"array(array(array({x0}, {y0}), array({x1}, {y0}), array({x1}, {y1}), array({x0}, {y1})))"
    far = spark.range(12_000).selectExpr("format_string('far%05d', id) as code", ring("10D + 3 * id", "0D", "12D + 3 * id", "2D") + " as rings")
    cell = spark.range(n * n).selectExpr(f"id div {n} as i", f"id % {n} as j")
    near = cell.selectExpr("format_string('near%03d%03d', i, j) as code", ring(f"i * {side}D", f"j * {side}D", f"(i + 1) * {side}D", f"(j + 1) * {side}D") + " as rings")
    frame = far.unionByName(near)
    rows, full, _ = polygon_cells(frame, "code", "rings")
    assert full.count() > 0
    cells = rows.groupBy("_level", "_cx", "_cy").agg(F.collect_list(F.struct("_code", "_odd", "_edges")).alias("c"))
    most = cells.select(F.length(F.to_json("c")).alias("size")).agg(F.max("size")).first()[0]
    assert most < 1 << 20
    rnd = random.Random(2)
    points = [(rnd.uniform(0, 1), rnd.uniform(0, 1)) for _ in range(500)] + [(11.0 + 3 * k, 1.0) for k in range(0, 9000, 90)]
    got = join(spark, points, frame)
    for i, (x, y) in enumerate(points):
        assert got[i] == (f"near{int(x / side):03}{int(y / side):03}" if x < 1 else f"far{round((x - 11) / 3):05}")


def test_parts_are_taken_as_they_are(spark):
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    hole = [[0.2, 0.2], [0.4, 0.2], [0.4, 0.4], [0.2, 0.4]]
    polygons = spark.createDataFrame([("m", [[square, hole], [[[x + 3, y] for x, y in square]]])], "code string, parts array<array<array<array<double>>>>")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.3, 0.3), (3, 3.5, 0.5), (4, 2.0, 0.5)], "id int, lon double, lat double")
    assert {r["id"]: r["code"] for r in spatial_join(points, polygons, rings="parts").collect()} == {1: "m", 2: None, 3: "m", 4: None}
