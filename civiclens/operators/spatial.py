"""Spatial operators: point-in-polygon join, extents, label placement, edges
(J8, X9, X10, P18, P19, W3).

Spark has no containment predicate, so the join is an equi-join on grid cells
followed by an exact even-odd test:

1. each polygon is cut by the cells of its bounding box, first into rows of cells, then into
   cells. A cell keeps only the edges near it and one parity: whether its lower right corner
   is inside. A cell without edges stays only if that corner is inside;
2. cells where many edges lie are cut again, 16 by 16, up to twice (a quadtree by edge
   counts, four levels a step). A smaller cell's parity follows from the edges and the parity of the one around it;
3. the polygons of a cell are gathered into one candidate list, short because of step 2;
4. each point gets the smallest cell around it and is LEFT joined to the cell table -- one
   row per point out, so no aggregation over points is needed afterwards; among the
   candidates that contain the point the smallest code wins.

Which cells are cut again is a small table: a cell has to hold more edges than `most_edges` and than
a fixed share of all edges, so the table's rows are bounded and it is broadcast. The cell table
is broadcast by AQE only after its size is measured; above the threshold the join stays
a sort-merge join on the cell, and AQE's skew join splits a hot cell on the point side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def polygon_edges(rings: Column) -> Column:
    """All edges (x1, y1, x2, y2) of all rings, closing edge included."""
    def ring_edges(r):
        n = F.size(r)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
            F.get(r, i)[0].alias("x1"), F.get(r, i)[1].alias("y1"),
            F.get(r, (i + 1) % n)[0].alias("x2"), F.get(r, (i + 1) % n)[1].alias("y2")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), ring_edges))


def _bbox_of_rings(rings: Column) -> Column:
    pts = F.flatten(rings)
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


#: Levels of halving that one step cuts a full cell by (cells are cut twice at most), and the largest number of
#: cells that are cut in each step (what bounds the broadcast table).
STEP = 4
MOST_CUT = 30_000


def rings_of(polygons: DataFrame, rings: str) -> Column:
    """All rings of a polygon column: rings as they are, the rings of all parts of a MultiPolygon column."""
    kind = polygons.schema[rings].dataType
    depth = 0
    while isinstance(kind, ArrayType):
        kind, depth = kind.elementType, depth + 1
    return F.flatten(F.col(rings)) if depth == 4 else F.col(rings)


# SQL texts: one expression each for the parser, where columns would be put together call by call.

def _crossed(px: str, py: str) -> str:
    """The ray from (px, py) to +x crosses the edge e."""
    return f"((e.y1 > {py}) <> (e.y2 > {py}) and {px} < (e.x2 - e.x1) * ({py} - e.y1) / (e.y2 - e.y1) + e.x1)"


def _inside_cell(px: str, py: str, edges: str, odd: str, right: str) -> str:
    """Even-odd rule for a point of a cell by the cell's own edges. `right` is the cell's right side.

    Of an edge beyond the cell nothing is left but its ends: what it adds to the rays of the point and of the
    cell's corner is known from the ends that lie right of the cell, and each end belongs to two edges.
    So the ends of the near edges make up for all edges that are not here; the part that does
    not depend on the point is in `odd`."""
    ends = f"((e.x1 > {right} and e.y1 > {py}) <> (e.x2 > {right} and e.y2 > {py}))"
    return f"({odd} <> aggregate({edges}, false, (acc, e) -> acc <> ({_crossed(px, py)} <> {ends})))"


def _cell_parity(corner_inside: str, edges: str, right: str, low: str) -> str:
    """The parity that `_inside_cell` takes, from that of the corner (right, low)."""
    return _inside_cell(right, low, edges, corner_inside, right)


def _near(left: str, right: str, low: str, high: str) -> str:
    """The edge e meets the box: their extents overlap and the box's corners are not all on one side of the edge's line."""
    side = ", ".join(f"(e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1)" for x in (left, right) for y in (low, high))
    return (f"(greatest(e.x1, e.x2) >= {left} and least(e.x1, e.x2) <= {right} and greatest(e.y1, e.y2) >= {low} and least(e.y1, e.y2) <= {high} "
            f"and least({side}) <= 0 and greatest({side}) >= 0)")


def _size(level: str) -> str:
    """Side of a cell; halving is exact, so lines of all levels agree."""
    return f"(_cell / power(2e0, {level}))"


def _full_cells(edges: DataFrame, most_edges: int) -> DataFrame:
    """_fx, _fy of the largest cells that hold the middles of more edges than they should, and _sub, which of the
    cells inside do so too (numbers below 4 ** STEP)."""
    n = 1 << STEP
    node = f"named_struct('l', {{0}}, 'x', floor((e.x1 + e.x2) / 2 / {_size('{0}')}), 'y', floor((e.y1 + e.y2) / 2 / {_size('{0}')}))"
    count = (edges.selectExpr("_cell", "_total", "explode(_edges) as e").selectExpr("_total", f"explode(array({node.format(0)}, {node.format(STEP)})) as node")
             .groupBy("node").agg(F.count("*").alias("n"), F.max("_total").alias("_total")))
    full = count.where(f"n > {most_edges} and n > _total / {MOST_CUT}").selectExpr(
        f"if(node.l = 0, node.x, floor(node.x / {n})) as _fx", f"if(node.l = 0, node.y, floor(node.y / {n})) as _fy",
        f"if(node.l = 0, null, pmod(node.y, {n}) * {n} + pmod(node.x, {n})) as sub")
    return full.groupBy("_fx", "_fy").agg(F.collect_list("sub").alias("_sub"))


def _touched(rows: DataFrame, odd: str, edges: str, *also: str) -> DataFrame:
    """The rows whose polygon has something in the cell. As a generator: a filter would be pushed down with a copy of both expressions."""
    return rows.selectExpr("_code", "_bb", "_cell", "_level", "_cx", "_cy", *also,
                           f"inline(filter(array(named_struct('_odd', {odd}, '_edges', {edges})), s -> s._odd or size(s._edges) > 0))")


def _cut(rows: DataFrame, is_full: str, sub: str) -> DataFrame:
    """The (polygon, cell) rows, full ones cut into 2 ** STEP by as many. sub: whether the new cell is full, by its number _child."""
    n = 1 << STEP
    rows = rows.selectExpr("_code", "_bb", "_cell", "_level", "_cx", "_cy", "_odd", "_edges", "_sub", f"explode(if({is_full}, sequence(0, {n * n - 1}), array(-1))) as _child")
    rows = rows.selectExpr(
        "_code", "_bb", "_cell", "_odd", "_edges", "_sub", "_child < 0 as _old", f"if(_child < 0, _level, _level + {STEP}) as _level",
        f"if(_child < 0, _cx, _cx * {n} + _child % {n}) as _cx", f"if(_child < 0, _cy, _cy * {n} + _child div {n}) as _cy", f"(_cx + 1) * {_size('_level')} as _outer",
        f"coalesce(_child >= 0 and {sub}, false) as _full")
    rows = rows.selectExpr("*", f"(_cx + 1) * {_size('_level')} as _right", f"_cy * {_size('_level')} as _low", f"{_size('_level')} as _s", f"{_size('_level')} * 1e-6 as _pad")
    near = _near("_right - _s - _pad", "_right + _pad", "_low - _pad", "_low + _s + _pad")
    rows = rows.selectExpr("_code", "_bb", "_cell", "_level", "_cx", "_cy", "_old", "_odd", "_right", "_low", "_sub", "_full",
                           f"if(_old, _edges, filter(_edges, e -> {near})) as _mine",
                           f"if(_old, null, {_inside_cell('_right', '_low', '_edges', '_odd', '_outer')}) as _corner")
    return _touched(rows, f"if(_old, _odd, {_cell_parity('_corner', '_mine', '_right', '_low')})", "_mine", "_sub", "_full")


def polygon_cells(polygons: DataFrame, code: str, rings: str, cell_size: float | None = None, most_edges: int = 1000) -> tuple[DataFrame, DataFrame, Column]:
    """The (polygon, cell) rows _code, _bb, _level, _cx, _cy, _odd, _edges; the cells that were cut; the largest cell's size and the
    number of edges, as a struct (cell, total)."""
    poly = polygons.select(F.col(code).alias("_code"), rings_of(polygons, rings).alias("_rings")).where(
        F.col("_code").isNotNull() & F.exists("_rings", lambda r: F.size(r) > 0))
    poly = poly.select("_code", _bbox_of_rings(F.col("_rings")).alias("_bb"), polygon_edges(F.col("_rings")).alias("_edges"))
    # Median polygon extent: about one to four cells per polygon. One row, attached once per side as a column.
    ext = F.greatest(F.col("_bb.maxx") - F.col("_bb.minx"), F.col("_bb.maxy") - F.col("_bb.miny"))
    median = F.coalesce(F.nullif(F.percentile_approx(ext, 0.5, 10000), F.lit(0.0)), F.nullif(F.max(ext), F.lit(0.0)), F.lit(1.0))
    cell = median if cell_size is None else F.lit(cell_size).cast("double")
    stats = poly.select(F.struct(cell.alias("cell"), F.sum(F.size("_edges")).alias("total"))).scalar()
    poly = poly.withColumn("_stats", stats).selectExpr("_code", "_bb", "_edges", "_stats.cell as _cell", "_stats.total as _total")
    full = _full_cells(poly, most_edges)
    pad = "_cell * 1e-6"
    rows = poly.selectExpr("_code", "_bb", "_edges", "_cell", f"explode(sequence(floor((_bb.miny - {pad}) / _cell), floor((_bb.maxy + {pad}) / _cell))) as _cy")
    rows = rows.selectExpr("_code", "_bb", "_edges", "_cell", "_cy", "_cy * _cell as _low", "(_cy + 1) * _cell as _high")
    rows = rows.selectExpr("_code", "_bb", "_cell", "_cy", "_low", "_high",
                           f"filter(_edges, e -> greatest(e.y1, e.y2) >= _low - {pad} and least(e.y1, e.y2) <= _high + {pad}) as _band")
    # where the row's lower line crosses the polygon
    line = "transform(filter(_band, e -> (e.y1 > _low) <> (e.y2 > _low)), e -> (e.x2 - e.x1) * (_low - e.y1) / (e.y2 - e.y1) + e.x1)"
    rows = rows.selectExpr("_code", "_bb", "_cell", "_cy", "_low", "_high", "_band", f"{line} as _line",
                           f"explode(sequence(floor((_bb.minx - {pad}) / _cell), floor((_bb.maxx + {pad}) / _cell))) as _cx")
    rows = rows.selectExpr("*", "(_cx + 1) * _cell as _right", "_cx * _cell as _left")
    near = _near(f"_left - {pad}", f"_right + {pad}", f"_low - {pad}", f"_high + {pad}")
    rows = rows.selectExpr("_code", "_bb", "_cell", "0 as _level", "_cx", "_cy", "_right", "_low", "size(filter(_line, x -> x > _right)) % 2 = 1 as _corner",
                           f"filter(_band, e -> {near}) as _edges")
    rows = _touched(rows, _cell_parity("_corner", "_edges", "_right", "_low"), "_edges")
    rows = rows.join(F.broadcast(full), F.expr("_cx = _fx and _cy = _fy"), "left")
    rows = _cut(_cut(rows, "_fx is not null", "array_contains(_sub, _child)"), "_full", "false")
    return rows.drop("_cell", "_sub", "_full"), full, stats


#: Reference systems that points can be brought to: longitude and latitude, and National Grid metres.
WGS84, BNG = "EPSG:4326", "EPSG:27700"


def reference_system(polygons: DataFrame, rings: str, default: str = WGS84) -> str:
    """The reference system that the metadata of a polygon column name (see sources.readers.read_geojson)."""
    return polygons.schema[rings].metadata.get("crs", default)


def in_system(points: DataFrame, x: str, y: str, system: str, wanted: str, out_x: str, out_y: str) -> DataFrame:
    """points with out_x, out_y: x, y as doubles, brought to the wanted reference system."""
    from civiclens.operators.geometry import projected_ring, with_wgs84
    if system == wanted:
        return points.withColumns({out_x: F.col(x).cast("double"), out_y: F.col(y).cast("double")})
    if (system, wanted) == (WGS84, BNG):
        at = projected_ring(f"array(array(cast(`{x}` as double), cast(`{y}` as double)))")
        return points.withColumn("_at", at).withColumns({out_x: F.col("_at")[0][0], out_y: F.col("_at")[0][1]}).drop("_at")
    if (system, wanted) == (BNG, WGS84):
        return with_wgs84(points, x, y, out_y, out_x)
    raise ValueError(f"no way from {system} to {wanted}")


def spatial_join(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat",
                 code: str = "code", rings: str = "rings", out: str | None = None,
                 cell_size: float | None = None, strict: bool = True, most_edges: int = 1000,
                 points_system: str = WGS84) -> DataFrame:
    """Every point row with the code of the polygon containing it (NULL if none;
    the smallest code if several). `rings` holds all rings of a polygon (outer ring,
    holes, other parts) or its parts, each with its rings; the even-odd rule over all of them handles
    holes and multi-part polygons. Points with a NULL coordinate match nothing.

    strict=True is `within`: a point exactly on a polygon's boundary is not inside it. With
    strict=False the ray rule puts a point on a shared edge in one neighbour.

    The points' reference system is `points_system`, the polygons' is in their column's metadata (none: the
    points'). Where they differ the points are projected first (X5); x and y stay as they are.

    Nothing runs while the query is built. AQE measures the cell table and broadcasts it if it is
    small; otherwise the join stays a shuffle join on the cell, where AQE splits hot cells. A candidate list
    holds about `most_edges` edges, more only where that many meet in the smallest cell (1/256 of the
    largest)."""
    out = out or code
    rows, full, stats = polygon_cells(polygons, code, rings, cell_size, most_edges)
    cells = rows.groupBy("_level", "_cx", "_cy").agg(F.collect_list(F.struct("_code", "_bb", "_odd", "_edges")).alias("_cand"))
    at = lambda v, level: f"floor({v} / {_size(level)})"
    # points without a coordinate match nothing: they get cells of their own, one per input partition
    kept = [f"`{c}`" for c in points.columns]
    n = 1 << STEP
    pts = in_system(points, x, y, points_system, reference_system(polygons, rings, points_system), "_px", "_py").withColumn("_stats", stats)
    pts = pts.selectExpr(*kept, "_px", "_py", "_stats.cell as _cell").selectExpr(
        "*", f"coalesce({at('_px', 0)}, {-(1 << 50)} - spark_partition_id()) as _x0", f"coalesce({at('_py', 0)}, {-(1 << 50)}) as _y0")
    pts = pts.join(F.broadcast(full), F.expr("_x0 = _fx and _y0 = _fy"), "left").selectExpr(
        *kept, "_px", "_py", "_cell", "_x0", "_y0",
        f"case when _fx is null then 0 when array_contains(_sub, pmod({at('_py', STEP)}, {n}) * {n} + pmod({at('_px', STEP)}, {n})) then {2 * STEP} else {STEP} end as _level")
    pts = pts.selectExpr(*kept, "_px", "_py", "_cell", "_level", f"if(_level = 0, _x0, {at('_px', '_level')}) as _cx", f"if(_level = 0, _y0, {at('_py', '_level')}) as _cy")
    joined = pts.join(cells, ["_level", "_cx", "_cy"], "left").selectExpr(*kept, "_px", "_py", "_cand", f"(_cx + 1) * {_size('_level')} as _right")
    inside = "_px >= c._bb.minx and _px <= c._bb.maxx and _py >= c._bb.miny and _py <= c._bb.maxy and " + _inside_cell(
        "_px", "_py", "c._edges", "c._odd", "_right")
    if strict:
        on = ("(e.x2 - e.x1) * (_py - e.y1) - (e.y2 - e.y1) * (_px - e.x1) = 0 and _px >= least(e.x1, e.x2) and _px <= greatest(e.x1, e.x2) "
              "and _py >= least(e.y1, e.y2) and _py <= greatest(e.y1, e.y2)")
        inside += f" and not exists(c._edges, e -> {on})"
    match = F.expr(f"array_min(transform(filter(_cand, c -> {inside}), c -> c._code))")
    return joined.withColumn(out, match).drop("_px", "_py", "_cand", "_right")


def extent(df: DataFrame, rings: str) -> DataFrame:
    """Total bounds (minx, miny, maxx, maxy) of all vertices; one row."""
    bb = _bbox_of_rings(F.col(rings))
    return df.select(bb.alias("b")).agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"),
                                        F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


def padded_extent(ext: DataFrame, margin_fraction: float | None = None,
                  pad: float | None = None, digits: int = 6) -> DataFrame:
    """Bounds widened by a fraction of the range (per axis) or by a fixed pad."""
    if margin_fraction is not None:
        mx = (F.col("maxx") - F.col("minx")) * margin_fraction
        my = (F.col("maxy") - F.col("miny")) * margin_fraction
    else:
        mx = my = F.lit(float(pad or 0.0))
    r = lambda c: F.round(c, digits)
    return ext.select(*[r(F.col(c)).alias(c) for c in ("minx", "miny", "maxx", "maxy")],
                      r(mx).alias("x_margin"), r(my).alias("y_margin"),
                      r(F.col("minx") - mx).alias("xlim_lo"), r(F.col("maxx") + mx).alias("xlim_hi"),
                      r(F.col("miny") - my).alias("ylim_lo"), r(F.col("maxy") + my).alias("ylim_hi"))


def area_centroids(df: DataFrame, rings: str, parts: bool = False) -> DataFrame:
    """Adds centroid_x, centroid_y (planar). `rings` is one polygon's rings (the
    outer ring is used), or with parts=True a MultiPolygon's parts -> rings, whose
    centroid is area-weighted over parts with holes subtracted."""
    from civiclens.functions.geo import parts_area_centroid
    from civiclens.operators.geometry import with_area_centroid
    if parts:
        d = df.withColumn("_pc", parts_area_centroid(F.col(rings)))
        return d.withColumns({"centroid_x": F.col("_pc.x"), "centroid_y": F.col("_pc.y")}).drop("_pc")
    d = df.withColumn("_outer", F.get(F.col(rings), 0))
    return with_area_centroid(d, "_outer", "centroid_x", "centroid_y").drop("_outer")


def nearest_edge(df: DataFrame, ext: DataFrame, x: str = "centroid_x", y: str = "centroid_y") -> DataFrame:
    """The bounding-box edge nearest to each point; ties go left, right, top,
    bottom in that order. Points with a NULL coordinate get no side. The extent is
    one row, used through scalar subqueries."""
    # The extent is attached once as a column: every later reference reads that
    # column instead of carrying its own copy of the subquery.
    df = df.withColumn("_ext", ext.select(F.struct("minx", "miny", "maxx", "maxy")).scalar())
    minx, maxx, miny, maxy = F.col("_ext.minx"), F.col("_ext.maxx"), F.col("_ext.miny"), F.col("_ext.maxy")
    dl, dr = F.abs(F.col(x) - minx), F.abs(maxx - F.col(x))
    db, dt = F.abs(F.col(y) - miny), F.abs(maxy - F.col(y))
    m = F.least(dl, dr, dt, db)
    side = (F.when(F.col(x).isNull() | F.col(y).isNull(), F.lit(None))
            .when(dl == m, "left").when(dr == m, "right").when(dt == m, "top").otherwise("bottom"))
    return df.withColumn("side", side).drop("_ext")


def even_spacing(df: DataFrame, ext: DataFrame, margin_fraction: float, key: str,
                 x: str = "centroid_x", y: str = "centroid_y", digits: int = 6) -> DataFrame:
    """Labels per side ordered along the side (south->north for left/right,
    west->east for top/bottom, ties by key) and spaced evenly: position
    lo + (i+1)(hi-lo)/(n+1); the other coordinate sits outside the box by the margin.
    The window is partitioned by side over map areas (a bounded set)."""
    df = df.withColumn("_ext", ext.select(F.struct("minx", "miny", "maxx", "maxy")).scalar())
    minx, maxx, miny, maxy = F.col("_ext.minx"), F.col("_ext.maxx"), F.col("_ext.miny"), F.col("_ext.maxy")
    xm, ym = (maxx - minx) * margin_fraction, (maxy - miny) * margin_fraction
    vertical = F.col("side").isin("left", "right")
    along = F.when(vertical, F.col(y)).otherwise(F.col(x))
    w = Window.partitionBy("side").orderBy(along, F.col(key))
    # Areas without a side (no centroid) form their own window group and keep NULL
    # label positions. No filter on `side`: a predicate on a window partition column
    # is pushed below the window and would copy the centroid expressions into it.
    d = (df.withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
         .withColumn("n_side", F.count("*").over(Window.partitionBy("side"))))
    i1 = (F.col("rank") + 1).cast("double")
    ystep = (maxy - miny) / (F.col("n_side") + 1)
    xstep = (maxx - minx) / (F.col("n_side") + 1)
    lx = (F.when(F.col("side") == "left", minx - xm).when(F.col("side") == "right", maxx + xm)
          .otherwise(i1 * xstep + minx))
    ly = (F.when(F.col("side") == "top", maxy + ym).when(F.col("side") == "bottom", miny - ym)
          .otherwise(i1 * ystep + miny))
    has = F.col("side").isNotNull()
    return d.withColumns({"label_x": F.when(has, F.round(lx, digits)),
                          "label_y": F.when(has, F.round(ly, digits))}).drop("_ext")


def comment_application_edges(comments: DataFrame, lat: str = "lat", lon: str = "lon",
                              app_lat: str = "centroid_lat", app_lon: str = "centroid_lon") -> DataFrame:
    """Edges (comment point -> application point) where both ends are known."""
    return comments.na.drop(subset=[lat, lon, app_lat, app_lon])
