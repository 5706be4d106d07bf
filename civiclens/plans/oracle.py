"""DuckDB oracle SQL for the registered queries.

Each string starts with the fixture views as WITH clauses and computes the same
result by plain SQL (long-form views instead of arrays, self-joins and edge-parity
counts instead of generators), as an independent check of the Spark plans. Floats
are rounded to 6 places on both sides. Histogram and box-statistics shapes repeat,
so two small functions write them."""

from __future__ import annotations

from civiclens import constants as K
from civiclens.operators import regression as RG
from civiclens.sources.fixtures import FIXTURE_BOROUGH, FIXTURE_INNER, FIXTURE_TOPIC, with_views

ORACLE: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(vals) -> str:
    return ", ".join(_q(v) if isinstance(v, str) else str(v) for v in vals)


def R(expr: str, d: int = 6) -> str:
    return f"ROUND({expr}, {d})"


INNER = _list(FIXTURE_INNER)
HOUSING = _list(K.HOUSING_ORDER)
STANCES = _list(K.STANCES)
NIMBY = _list(K.NIMBY_TOPIC_IDS)
B = _q(FIXTURE_BOROUGH)
T = FIXTURE_TOPIC

# -- shared CTE bodies ------------------------------------------------------------------
NAMES_ORDERED = ("names_o AS (SELECT Topic AS topic_id, Count AS topic_count, topic_group, color, "
                 "ROW_NUMBER() OVER (ORDER BY Count DESC, Topic) - 1 AS file_order FROM fx_topic_names)")
TOPIC_TEXT = ("tt AS (SELECT comment_id, '[' || string_agg(CAST(topic AS VARCHAR), ', ' ORDER BY pos) || ']' "
              "AS topic_number FROM fx_topic_long GROUP BY comment_id)")
# Polygons from the vertex view: vertex count, closure, validity (>= 4 coordinates once closed).
POLY = """poly AS (
  SELECT v.lpa_app_no, v.borough, v.src_ord, COUNT(*) AS nv,
    MAX(CASE WHEN v.pos = 0 THEN x END) AS x0, MAX(CASE WHEN v.pos = 0 THEN y END) AS y0,
    arg_max(x, pos) AS xl, arg_max(y, pos) AS yl
  FROM fx_vertex v GROUP BY 1, 2, 3),
poly_ok AS (SELECT *, nv + CASE WHEN x0 = xl AND y0 = yl THEN 0 ELSE 1 END >= 4 AS valid FROM poly),
edges AS (
  SELECT v.lpa_app_no, v.borough, v.src_ord, v.pos, v.x - p.x0 AS xi, v.y - p.y0 AS yi,
    LEAD(v.x, 1, p.x0) OVER w - p.x0 AS xj, LEAD(v.y, 1, p.y0) OVER w - p.y0 AS yj, p.x0, p.y0
  FROM fx_vertex v JOIN poly_ok p USING (lpa_app_no, borough, src_ord)
  WHERE p.valid
  WINDOW w AS (PARTITION BY v.lpa_app_no, v.borough, v.src_ord ORDER BY v.pos)),
shoelace AS (
  SELECT lpa_app_no, borough, src_ord, SUM(xi * yj - xj * yi) AS a, SUM(len) AS l, SUM((xi + xj) / 2 * len) AS lx, SUM((yi + yj) / 2 * len) AS ly,
    SUM((xi + xj) * (xi * yj - xj * yi)) AS sx, SUM((yi + yj) * (xi * yj - xj * yi)) AS sy,
    MAX(x0) AS x0, MAX(y0) AS y0
  FROM (SELECT *, SQRT((xj - xi) * (xj - xi) + (yj - yi) * (yj - yi)) AS len FROM edges) e GROUP BY 1, 2, 3),
area_c AS (
  SELECT lpa_app_no, borough, src_ord, CASE WHEN a <> 0 THEN sx / (a * 3) WHEN l > 0 THEN lx / l ELSE 0 END + x0 AS cx,
    CASE WHEN a <> 0 THEN sy / (a * 3) WHEN l > 0 THEN ly / l ELSE 0 END + y0 AS cy, a / 2 AS area
  FROM shoelace)"""
CENTROID_LOOKUP = """cl AS (
  SELECT lpa_app_no, borough, cy AS centroid_lat, cx AS centroid_lon FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY lpa_app_no ORDER BY src_ord) AS rn FROM area_c
    WHERE cx IS NOT NULL AND cy IS NOT NULL) WHERE rn = 1)"""
HAV = "6371e0 * 2 * ASIN(CASE WHEN SQRT({a}) > 1 THEN 1e0 ELSE SQRT({a}) END)"


def _hav(lat1, lon1, lat2, lon2) -> str:
    p1, p2 = f"RADIANS({lat1})", f"RADIANS({lat2})"
    s1 = f"SIN((RADIANS({lat2}) - RADIANS({lat1})) / 2)"
    s2 = f"SIN((RADIANS({lon2}) - RADIANS({lon1})) / 2)"
    a = f"({s1} * {s1} + COS({p1}) * COS({p2}) * {s2} * {s2})"
    return HAV.format(a=a)


DIST = f"""tp AS (SELECT comment_id, topic FROM fx_topic_long),
dist AS (
  SELECT c.*, pl.housing_type, cl.centroid_lat AS app_lat, cl.centroid_lon AS app_lon,
    {_hav('c.lat', 'c.lon', 'cl.centroid_lat', 'cl.centroid_lon')} AS distance_km
  FROM fx_comments c
  LEFT JOIN fx_pld pl ON c.application_id = pl.lpa_app_no AND c.council = pl.borough
  LEFT JOIN cl ON c.application_id = cl.lpa_app_no AND c.council = cl.borough)"""

DIST_VIEWS = with_views("fx_pld", "fx_vertex", "fx_comments", "fx_topic_long")


def hist_sql(src: str, x: str, bins: int, keys: list[str], shared: bool) -> str:
    """Equal-width histogram with numpy's bin rule; src is a subquery name."""
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    join_r = ("JOIN r USING (" + k + ")") if (keys and not shared) else "CROSS JOIN r"
    rng_group = f"GROUP BY {k}" if (keys and not shared) else ""
    rng_sel = kc if (keys and not shared) else ""
    grid_src = (f"(SELECT DISTINCT {k} FROM hs) g CROSS JOIN r" if (keys and shared)
                else "r")
    grid_keys = "".join(f"g.{c}, " for c in keys) if (keys and shared) else ("".join(f"r.{c}, " for c in keys))
    using = ("USING (" + kc + "bin)")
    return f"""hs AS (SELECT {kc}CAST({x} AS DOUBLE) AS _x FROM {src} WHERE {x} IS NOT NULL
    {''.join(f' AND {c} IS NOT NULL' for c in keys)}),
r0 AS (SELECT {rng_sel}MIN(_x) AS lo0, MAX(_x) AS hi0 FROM hs {rng_group}),
r AS (SELECT *, CASE WHEN lo0 = hi0 THEN lo0 - 5e-1 ELSE lo0 END AS lo,
                CASE WHEN lo0 = hi0 THEN hi0 + 5e-1 ELSE hi0 END AS hi FROM r0),
hb AS (SELECT {''.join(f'hs.{c}, ' for c in keys)}hs._x, r.lo, (r.hi - r.lo) / {bins}e0 AS step,
         LEAST(GREATEST(FLOOR((hs._x - r.lo) * ({bins}e0 / (r.hi - r.lo))), 0), {bins - 1}) AS i0
       FROM hs {join_r}),
hc AS (SELECT {kc}CASE WHEN _x < i0 * step + lo THEN i0 - 1
                    WHEN i0 < {bins - 1} AND _x >= (i0 + 1) * step + lo THEN i0 + 1 ELSE i0 END AS bin
       FROM hb),
hn AS (SELECT {kc}bin, COUNT(*) AS n FROM hc GROUP BY {kc}bin),
hg AS (SELECT {grid_keys}CAST(s.bin AS BIGINT) AS bin, r.lo, r.hi FROM {grid_src} CROSS JOIN range(0, {bins}) s(bin))
SELECT {kc}CAST(bin AS INT) AS bin,
  ROUND(bin * ((hi - lo) / {bins}e0) + lo, 6) AS bin_lo,
  ROUND(CASE WHEN bin = {bins - 1} THEN hi ELSE (bin + 1) * ((hi - lo) / {bins}e0) + lo END, 6) AS bin_hi,
  COALESCE(n, 0) AS n
FROM hg LEFT JOIN hn {using}"""


def box_sql(src: str, x: str, keys: list[str]) -> str:
    """Box statistics (matplotlib whisker rules) per group; src is a subquery name."""
    k = ", ".join(keys)
    return f"""bs AS (SELECT {k}, CAST({x} AS DOUBLE) AS _v FROM {src} WHERE {x} IS NOT NULL),
bq AS (SELECT {k}, COUNT(*) AS n, AVG(_v) AS mean, quantile_cont(_v, 0.25) AS q1,
         quantile_cont(_v, 0.5) AS median, quantile_cont(_v, 0.75) AS q3 FROM bs GROUP BY {k}),
bf AS (SELECT *, q1 - 15e-1 * (q3 - q1) AS lof, q3 + 15e-1 * (q3 - q1) AS hif FROM bq),
bw AS (SELECT {k}, MAX(CASE WHEN bs._v <= bf.hif THEN bs._v END) AS whi,
         MIN(CASE WHEN bs._v >= bf.lof THEN bs._v END) AS wlo FROM bs JOIN bf USING ({k}) GROUP BY {k}),
bst AS (SELECT bf.*, CASE WHEN bw.whi IS NULL OR bw.whi < bf.q3 THEN bf.q3 ELSE bw.whi END AS whishi,
          CASE WHEN bw.wlo IS NULL OR bw.wlo > bf.q1 THEN bf.q1 ELSE bw.wlo END AS whislo
        FROM bf JOIN bw USING ({k})),
bfl AS (SELECT {k}, COUNT(*) FILTER (WHERE bs._v < bst.whislo OR bs._v > bst.whishi) AS n_fliers
        FROM bs JOIN bst USING ({k}) GROUP BY {k}),
box AS (SELECT {k}, n, ROUND(mean, 6) AS mean, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median,
          ROUND(q3, 6) AS q3, ROUND(whislo, 6) AS whislo, ROUND(whishi, 6) AS whishi, n_fliers
        FROM bst JOIN bfl USING ({k}))"""


def _add(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


# -- G1-G4, P9, G10, G13, S8 -----------------------------------------------------------
_add("stance_by_council", with_views("fx_comments") + f"""
SELECT council, supports, objects, neutral,
  ROUND(supports / NULLIF(tot, 0) * 1e2, 6) AS pct_supports, ROUND(objects / NULLIF(tot, 0) * 1e2, 6) AS pct_objects,
  ROUND(neutral / NULLIF(tot, 0) * 1e2, 6) AS pct_neutral
FROM (SELECT council,
        COUNT(*) FILTER (WHERE stance = 'Supports') AS supports,
        COUNT(*) FILTER (WHERE stance = 'Objects') AS objects,
        COUNT(*) FILTER (WHERE stance = 'Neutral') AS neutral,
        COUNT(*) FILTER (WHERE stance IN ({STANCES})) AS tot
      FROM fx_comments WHERE council IS NOT NULL GROUP BY council) s""")

_add("overall_summary", with_views("fx_applications") + """
SELECT COUNT(DISTINCT lpa_app_no) AS total_applications,
  CAST(COALESCE(SUM(total_no_proposed_residential_units), 0) AS BIGINT) AS total_proposed_residential_units,
  CAST(COALESCE(SUM(comment_count), 0) AS BIGINT) AS total_comments,
  ROUND(AVG(comment_count), 2) AS mean_comments_per_application
FROM fx_applications""")

_add("council_stats", with_views("fx_applications") + """
SELECT borough, COUNT(lpa_app_no) AS total_applications,
  CAST(COALESCE(SUM(total_no_proposed_residential_units), 0) AS BIGINT) AS total_proposed_units,
  CAST(COALESCE(SUM(comment_count), 0) AS BIGINT) AS total_comments, ROUND(AVG(comment_count), 6) AS mean_comments
FROM fx_applications WHERE borough IS NOT NULL GROUP BY borough""")

_add("stance_size", with_views("fx_comments") + """
SELECT stance, COUNT(*) AS n FROM fx_comments WHERE stance IS NOT NULL GROUP BY stance""")

_add("inner_outer_flag", with_views("fx_comments") + f"""
SELECT comment_id, council,
  CASE WHEN COALESCE(council IN ({INNER}), false) THEN 'Inner London' ELSE 'Outer London' END AS london_area
FROM fx_comments""")

_add("distinct_boroughs", with_views("fx_applications") + "SELECT DISTINCT borough FROM fx_applications")

_add("comment_percentiles", with_views("fx_applications") + """
SELECT ROUND(quantile_cont(comment_count, 0.95), 6) AS p95, ROUND(quantile_cont(comment_count, 0.99), 6) AS p99
FROM fx_applications""")

_add("build_applications", with_views("fx_applications") + """
SELECT lpa_app_no, borough, housing_type, total_no_proposed_residential_units, comment_count FROM fx_applications""")

# -- lists and topics ------------------------------------------------------------------
_add("parse_topic_list", with_views("fx_comments", "fx_topic_long") + """
SELECT c.comment_id, t.n_topics, t.topic_sum, t.first_topic, t.last_topic
FROM fx_comments c LEFT JOIN (
  SELECT comment_id, COUNT(*) AS n_topics, CAST(SUM(topic) AS BIGINT) AS topic_sum, arg_min(topic, pos) AS first_topic,
    arg_max(topic, pos) AS last_topic
  FROM fx_topic_long GROUP BY comment_id) t USING (comment_id)""")

_add("parse_probability_list", with_views("fx_comments", "fx_topic_long") + """
SELECT c.comment_id, t.n_probs, ROUND(t.prob_sum, 6) AS prob_sum, t.n_zero
FROM fx_comments c LEFT JOIN (
  SELECT comment_id, COUNT(*) AS n_probs, SUM(COALESCE(prob, 0e0)) AS prob_sum,
    COUNT(*) FILTER (WHERE prob IS NULL OR prob = 0) AS n_zero
  FROM fx_topic_long GROUP BY comment_id) t USING (comment_id)""")

_MENTIONS = "m AS (SELECT l.topic, COUNT(*) AS mentions FROM fx_topic_long l JOIN fx_comments c USING (comment_id) GROUP BY l.topic)"
_FREQ_BASE = ("b AS (SELECT n.Topic AS topic_id, n.topic_group, n.color, COALESCE(m.mentions, 0) AS mentions "
              "FROM fx_topic_names n LEFT JOIN m ON n.Topic = m.topic)")
_FREQ = ("freq AS (SELECT topic_id, topic_group, color, mentions, "
         "ROUND(mentions / (SELECT SUM(mentions) FROM b) * 1e2, 2) AS percentage, "
         "ROW_NUMBER() OVER (ORDER BY mentions DESC, topic_id) - 1 AS rank FROM b)")

_add("topic_frequency", with_views("fx_comments", "fx_topic_names") + f""", {_MENTIONS}, {_FREQ_BASE}, {_FREQ}
SELECT * FROM freq""")

_add("topic_frequency_by_area", with_views("fx_comments", "fx_topic_names") + f""",
m AS (SELECT l.topic,
        COUNT(*) FILTER (WHERE COALESCE(c.council IN ({INNER}), false)) AS inner_count,
        COUNT(*) FILTER (WHERE NOT COALESCE(c.council IN ({INNER}), false)) AS outer_count
      FROM fx_topic_long l JOIN fx_comments c USING (comment_id) GROUP BY l.topic),
b AS (SELECT n.Topic AS topic_id, n.topic_group, n.color, COALESCE(m.inner_count, 0) AS inner_count,
        COALESCE(m.outer_count, 0) AS outer_count FROM fx_topic_names n LEFT JOIN m ON n.Topic = m.topic)
SELECT *, ROUND(inner_count / (SELECT SUM(inner_count) FROM b) * 1e2, 2) AS inner_pct,
  ROUND(outer_count / (SELECT SUM(outer_count) FROM b) * 1e2, 2) AS outer_pct
FROM b""")

_add("topic_by_housing_type", with_views("fx_comments", "fx_topic_names", "fx_applications") + f""", {NAMES_ORDERED},
cwt AS (SELECT c.comment_id, a.housing_type FROM fx_comments c LEFT JOIN fx_applications a ON c.application_id = a.lpa_app_no),
present AS (SELECT DISTINCT housing_type FROM cwt WHERE housing_type IN ({HOUSING})),
top AS (SELECT * FROM names_o WHERE file_order < {K.TOP_TOPICS_BAR}),
cnt AS (SELECT w.housing_type, l.topic, COUNT(*) AS mentions FROM fx_topic_long l JOIN cwt w USING (comment_id)
        WHERE w.housing_type IS NOT NULL GROUP BY 1, 2)
SELECT p.housing_type, t.topic_id, t.topic_group, t.color, t.file_order, COALESCE(cnt.mentions, 0) AS mentions
FROM present p CROSS JOIN top t LEFT JOIN cnt ON cnt.housing_type = p.housing_type AND cnt.topic = t.topic_id""")


def _pie(other_topic: str, other_color: str) -> str:
    return f""", {NAMES_ORDERED},
pie AS (
  SELECT file_order AS slice, CAST(topic_id AS INT) AS topic_id, topic_group, color, topic_count
  FROM names_o WHERE file_order < {K.TOP_TOPICS_BAR}
  UNION ALL
  SELECT {K.TOP_TOPICS_BAR}, CAST({other_topic} AS INT), {_q(K.OTHER_LABEL)}, {_q(other_color)},
    CAST(COALESCE(SUM(topic_count), 0) AS BIGINT) FROM names_o WHERE file_order >= {K.TOP_TOPICS_BAR}),
pie_s AS (SELECT *, ROUND(topic_count * 1e2 / (SELECT SUM(topic_count) FROM names_o), 6) AS share FROM pie)"""


_add("topic_top20_other", with_views("fx_topic_names") + _pie("NULL", K.OTHER_COLOR_PIE) + "\nSELECT * FROM pie_s")

_add("nimby_share", with_views("fx_topic_names") + _pie(str(K.OTHER_TOPIC_NIMBY), K.OTHER_COLOR_NIMBY) + f"""
SELECT *, COALESCE(topic_id IN ({NIMBY}), false) AS is_nimby,
  CASE WHEN COALESCE(topic_id IN ({NIMBY}), false) THEN color ELSE {_q(K.OTHER_COLOR_NIMBY)} END AS shown_color
FROM pie_s""")

_add("topic_cooccurrence", with_views("fx_comments", "fx_topic_names") + f""",
tl AS (SELECT l.comment_id, l.topic FROM fx_topic_long l JOIN fx_comments c USING (comment_id)),
top AS (SELECT topic FROM tl GROUP BY topic ORDER BY COUNT(*) DESC, topic LIMIT {K.TOP_TOPICS_COOCCURRENCE}),
ct AS (SELECT DISTINCT comment_id, topic FROM tl WHERE topic IN (SELECT topic FROM top)),
pr AS (SELECT a.topic AS a, b.topic AS b, COUNT(*) AS n FROM ct a JOIN ct b ON a.comment_id = b.comment_id AND a.topic < b.topic GROUP BY 1, 2),
sym AS (SELECT a, b, n FROM pr UNION ALL SELECT b, a, n FROM pr)
SELECT ta.topic AS topic_a, tb.topic AS topic_b,
  COALESCE(na.topic_group, CAST(ta.topic AS VARCHAR)) AS label_a,
  COALESCE(nb.topic_group, CAST(tb.topic AS VARCHAR)) AS label_b,
  COALESCE(sym.n, 0) AS n
FROM top ta CROSS JOIN top tb
LEFT JOIN sym ON sym.a = ta.topic AND sym.b = tb.topic
LEFT JOIN fx_topic_names na ON na.Topic = ta.topic
LEFT JOIN fx_topic_names nb ON nb.Topic = tb.topic""")

_PRIMARY = ("pt AS (SELECT comment_id, arg_min(topic, pos) FILTER (WHERE topic > 0) AS primary_topic "
            "FROM fx_topic_long GROUP BY comment_id)")

_add("primary_topic", with_views("fx_comments", "fx_topic_long") + f""", {_PRIMARY}
SELECT c.comment_id, pt.primary_topic FROM fx_comments c LEFT JOIN pt USING (comment_id)""")

_add("topic_lookup_default", with_views("fx_comments", "fx_topic_names") + f""", {_PRIMARY}
SELECT c.comment_id, pt.primary_topic, COALESCE(n.color, {_q(K.UNCLASSIFIED_COLOR)}) AS topic_color,
  COALESCE(n.topic_group, {_q(K.UNCLASSIFIED_LABEL)}) AS topic_label
FROM fx_comments c LEFT JOIN pt USING (comment_id) LEFT JOIN fx_topic_names n ON n.Topic = pt.primary_topic""")

_add("highlight_flag", with_views("fx_comments", "fx_topic_long") + f"""
SELECT c.comment_id, h.comment_id IS NOT NULL AS is_highlight
FROM fx_comments c LEFT JOIN (SELECT DISTINCT comment_id FROM fx_topic_long WHERE topic = {T}) h USING (comment_id)""")

# -- joins -------------------------------------------------------------------------------
_add("first_row_per_key", with_views("fx_vertex") + f""", {POLY}
SELECT lpa_app_no, borough, src_ord FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lpa_app_no ORDER BY src_ord) AS rn FROM poly_ok WHERE valid)
WHERE rn = 1""")

_add("comments_with_topics", with_views("fx_comments", "fx_topic_long") + f""", {TOPIC_TEXT}
SELECT c.comment_id, c.application_id, c.council, c.stance, tt.topic_number
FROM fx_comments c LEFT JOIN tt USING (comment_id)""")

_add("comments_with_housing", with_views("fx_comments", "fx_pld") + """
SELECT c.comment_id, c.application_id, c.council, p.housing_type, p.total_no_proposed_residential_units
FROM fx_comments c LEFT JOIN fx_pld p ON c.application_id = p.lpa_app_no AND c.council = p.borough""")

_add("comments_with_centroid", DIST_VIEWS + f""", {POLY}, {CENTROID_LOOKUP}, {DIST}
SELECT comment_id, ROUND(app_lat, 6) AS app_lat, ROUND(app_lon, 6) AS app_lon FROM dist""")

_add("haversine_distance", DIST_VIEWS + f""", {POLY}, {CENTROID_LOOKUP}, {DIST}
SELECT comment_id, ROUND(distance_km, 6) AS distance_km FROM dist""")

_CENSUS = """cen AS (SELECT lsoa_code,
  CASE WHEN residents = 0 THEN NULL ELSE (aged_50_69 + COALESCE(aged_70_plus, 0)) / residents * 1e2 END AS percent_age_50_plus,
  CASE WHEN employed = 0 THEN NULL ELSE (occ_1 + occ_2_3) / employed * 1e2 END AS percent_occupation_1_2_3,
  CASE WHEN households = 0 THEN NULL ELSE (owned_outright + COALESCE(owned_mortgage, 0)) / households * 1e2 END AS percent_owned_total
  FROM fx_census)"""

_add("census_features", with_views("fx_census") + f""", {_CENSUS}
SELECT lsoa_code, ROUND(percent_age_50_plus, 6) AS percent_age_50_plus,
  ROUND(percent_occupation_1_2_3, 6) AS percent_occupation_1_2_3, ROUND(percent_owned_total, 6) AS percent_owned_total
FROM cen""")

_add("semi_join_apps", with_views("fx_applications") + """
SELECT lpa_app_no, borough FROM fx_applications
WHERE lpa_app_no IN (SELECT application_id FROM fx_comments WHERE application_id IS NOT NULL)""")

# -- geometry ----------------------------------------------------------------------------
_add("vertex_mean_centroid", with_views("fx_vertex") + """
SELECT lpa_app_no, borough, src_ord, ROUND(AVG(y), 6) AS centroid_lat, ROUND(AVG(x), 6) AS centroid_lon
FROM fx_vertex GROUP BY 1, 2, 3""")

_add("area_centroid", with_views("fx_vertex") + f""", {POLY}
SELECT lpa_app_no, borough, src_ord, ROUND(cx, 6) AS centroid_x, ROUND(cy, 6) AS centroid_y, ROUND(area, 6) AS area
FROM area_c""")

_LSOA_EXT = """ext AS (SELECT MIN(LEAST(x1, x2, x3, x4)) AS minx, MIN(LEAST(y1, y2, y3, y4)) AS miny,
  MAX(GREATEST(x1, x2, x3, x4)) AS maxx, MAX(GREATEST(y1, y2, y3, y4)) AS maxy FROM fx_lsoa)"""
# Shoelace over the quad's four edges, shifted by the first vertex (same order as the ring).
_LSOA_CEN = """lc0 AS (SELECT lsoa_code, x1 AS x0, y1 AS y0,
    0e0 AS ax, 0e0 AS ay, x2 - x1 AS bx, y2 - y1 AS by_, x3 - x1 AS cx_, y3 - y1 AS cy_, x4 - x1 AS dx, y4 - y1 AS dy
  FROM fx_lsoa),
lc1 AS (SELECT lsoa_code, x0, y0,
    ax * by_ - bx * ay AS k1, bx * cy_ - cx_ * by_ AS k2, cx_ * dy - dx * cy_ AS k3, dx * ay - ax * dy AS k4,
    ax, ay, bx, by_, cx_, cy_, dx, dy FROM lc0),
lc AS (SELECT lsoa_code,
    (((((0e0 + (ax + bx) * k1) + (bx + cx_) * k2) + (cx_ + dx) * k3) + (dx + ax) * k4) + 0e0)
      / ((((((0e0 + k1) + k2) + k3) + k4) + 0e0) * 3) + x0 AS centroid_x,
    (((((0e0 + (ay + by_) * k1) + (by_ + cy_) * k2) + (cy_ + dy) * k3) + (dy + ay) * k4) + 0e0)
      / ((((((0e0 + k1) + k2) + k3) + k4) + 0e0) * 3) + y0 AS centroid_y
  FROM lc1),
sides AS (SELECT lc.*, ext.*, CASE
    WHEN ABS(centroid_x - minx) = LEAST(ABS(centroid_x - minx), ABS(maxx - centroid_x), ABS(maxy - centroid_y), ABS(centroid_y - miny)) THEN 'left'
    WHEN ABS(maxx - centroid_x) = LEAST(ABS(centroid_x - minx), ABS(maxx - centroid_x), ABS(maxy - centroid_y), ABS(centroid_y - miny)) THEN 'right'
    WHEN ABS(maxy - centroid_y) = LEAST(ABS(centroid_x - minx), ABS(maxx - centroid_x), ABS(maxy - centroid_y), ABS(centroid_y - miny)) THEN 'top'
    ELSE 'bottom' END AS side
  FROM lc CROSS JOIN ext)"""

_add("extent_padded", with_views("fx_lsoa") + f""", {_LSOA_EXT}
SELECT ROUND(minx, 6) AS minx, ROUND(miny, 6) AS miny, ROUND(maxx, 6) AS maxx, ROUND(maxy, 6) AS maxy,
  ROUND((maxx - minx) * 5e-2, 6) AS x_margin, ROUND((maxy - miny) * 5e-2, 6) AS y_margin,
  ROUND(minx - (maxx - minx) * 5e-2, 6) AS xlim_lo, ROUND(maxx + (maxx - minx) * 5e-2, 6) AS xlim_hi,
  ROUND(miny - (maxy - miny) * 5e-2, 6) AS ylim_lo, ROUND(maxy + (maxy - miny) * 5e-2, 6) AS ylim_hi
FROM ext""")

_add("nearest_edge", with_views("fx_lsoa") + f""", {_LSOA_EXT}, {_LSOA_CEN}
SELECT lsoa_code, ROUND(centroid_x, 6) AS centroid_x, ROUND(centroid_y, 6) AS centroid_y, side FROM sides""")

_add("even_spacing_rank", with_views("fx_lsoa") + f""", {_LSOA_EXT}, {_LSOA_CEN},
rk AS (SELECT s.*, ROW_NUMBER() OVER (PARTITION BY side ORDER BY CASE WHEN side IN ('left', 'right')
          THEN centroid_y ELSE centroid_x END, lsoa_code) - 1 AS rank,
        COUNT(*) OVER (PARTITION BY side) AS n_side FROM sides s)
SELECT lsoa_code, side, rank, n_side,
  ROUND(CASE side WHEN 'left' THEN minx - (maxx - minx) * 5e-2 WHEN 'right' THEN maxx + (maxx - minx) * 5e-2
        ELSE (rank + 1) * ((maxx - minx) / (n_side + 1)) + minx END, 6) AS label_x,
  ROUND(CASE side WHEN 'top' THEN maxy + (maxy - miny) * 5e-2 WHEN 'bottom' THEN miny - (maxy - miny) * 5e-2
        ELSE (rank + 1) * ((maxy - miny) / (n_side + 1)) + miny END, 6) AS label_y
FROM rk""")

# -- borough report frames -------------------------------------------------------------
_BOROUGH = f""", {_PRIMARY},
bapps AS (SELECT lpa_app_no, centroid_lat, centroid_lon FROM (
    SELECT lpa_app_no, src_ord, AVG(y) AS centroid_lat, AVG(x) AS centroid_lon,
      ROW_NUMBER() OVER (PARTITION BY lpa_app_no ORDER BY src_ord) AS rn
    FROM fx_vertex WHERE borough = {B} GROUP BY lpa_app_no, borough, src_ord) WHERE rn = 1),
hl AS (SELECT DISTINCT comment_id FROM fx_topic_long WHERE topic = {T}),
bc AS (SELECT c.*, a.centroid_lat, a.centroid_lon, pt.primary_topic,
    COALESCE(n.color, {_q(K.UNCLASSIFIED_COLOR)}) AS topic_color,
    COALESCE(n.topic_group, {_q(K.UNCLASSIFIED_LABEL)}) AS topic_label,
    hl.comment_id IS NOT NULL AS is_highlight
  FROM fx_comments c LEFT JOIN bapps a ON c.application_id = a.lpa_app_no
  LEFT JOIN pt USING (comment_id) LEFT JOIN fx_topic_names n ON n.Topic = pt.primary_topic
  LEFT JOIN hl ON hl.comment_id = c.comment_id
  WHERE c.council = {B})"""
_BVIEWS = with_views("fx_comments", "fx_vertex", "fx_topic_names")

_add("comment_application_edges", _BVIEWS + _BOROUGH + """
SELECT comment_id, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon, ROUND(centroid_lat, 6) AS centroid_lat,
  ROUND(centroid_lon, 6) AS centroid_lon
FROM bc WHERE lat IS NOT NULL AND lon IS NOT NULL AND centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL""")

_add("borough_topic_legend", _BVIEWS + _BOROUGH + f"""
SELECT primary_topic, topic_label, topic_color, COUNT(*) AS n FROM bc
WHERE lat IS NOT NULL AND lon IS NOT NULL AND primary_topic IS NOT NULL
GROUP BY 1, 2, 3 ORDER BY n DESC, primary_topic LIMIT {K.BOROUGH_LEGEND_TOP}""")

_add("borough_highlight_apps", _BVIEWS + _BOROUGH + """
SELECT lpa_app_no, ROUND(centroid_lat, 6) AS centroid_lat, ROUND(centroid_lon, 6) AS centroid_lon FROM bapps
WHERE lpa_app_no IN (SELECT application_id FROM bc WHERE is_highlight AND application_id IS NOT NULL)""")

_add("coverage_report", _BVIEWS + _BOROUGH + """
SELECT COUNT(*) AS n_comments,
  COUNT(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS with_coordinates,
  COUNT(*) FILTER (WHERE primary_topic IS NOT NULL) AS with_topic,
  COUNT(*) FILTER (WHERE is_highlight) AS with_highlight,
  COUNT(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL AND centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL) AS linkable,
  (SELECT COUNT(*) FROM bapps) AS apps_all,
  (SELECT COUNT(*) FROM bapps WHERE lpa_app_no IN (SELECT application_id FROM bc WHERE application_id IS NOT NULL)) AS apps_commented,
  (SELECT COUNT(*) FROM bapps WHERE lpa_app_no IN (SELECT application_id FROM bc WHERE is_highlight AND application_id IS NOT NULL)) AS apps_highlight
FROM bc""")

_add("borough_highlight_edges", _BVIEWS + _BOROUGH + """
SELECT comment_id, ROUND(lat, 6) AS lat, ROUND(lon, 6) AS lon, ROUND(centroid_lat, 6) AS centroid_lat, ROUND(centroid_lon, 6) AS centroid_lon
FROM bc WHERE is_highlight AND lat IS NOT NULL AND lon IS NOT NULL AND centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL""")

_add("borough_highlight_legend", _BVIEWS + _BOROUGH + """
SELECT COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE is_highlight) AS highlighted,
  COUNT(*) FILTER (WHERE is_highlight AND centroid_lat IS NOT NULL AND centroid_lon IS NOT NULL) AS highlighted_linked,
  COUNT(*) FILTER (WHERE NOT COALESCE(is_highlight, FALSE)) AS others
FROM bc WHERE lat IS NOT NULL AND lon IS NOT NULL""")

_add("map_extent", with_views("fx_lsoa") + f", {_LSOA_EXT}\n" + """
SELECT ROUND(minx, 6) AS minx, ROUND(miny, 6) AS miny, ROUND(maxx, 6) AS maxx, ROUND(maxy, 6) AS maxy, 4e-2 AS x_margin, 4e-2 AS y_margin,
  ROUND(minx - 4e-2, 6) AS xlim_lo, ROUND(maxx + 4e-2, 6) AS xlim_hi, ROUND(miny - 4e-2, 6) AS ylim_lo, ROUND(maxy + 4e-2, 6) AS ylim_hi FROM ext""")

# -- distributions -----------------------------------------------------------------------
_add("describe_distance", DIST_VIEWS + f""", {POLY}, {CENTROID_LOOKUP}, {DIST}
SELECT COUNT(distance_km) AS count, ROUND(AVG(distance_km), 6) AS mean, ROUND(STDDEV_SAMP(distance_km), 6) AS std,
  ROUND(MIN(distance_km), 6) AS min, ROUND(quantile_cont(distance_km, 0.25), 6) AS p25,
  ROUND(quantile_cont(distance_km, 0.5), 6) AS p50, ROUND(quantile_cont(distance_km, 0.75), 6) AS p75,
  ROUND(MAX(distance_km), 6) AS max
FROM dist""")

_add("hist_comments", with_views("fx_applications") + ", " + hist_sql("fx_applications", "comment_count", 50, [], False))

_add("hist_distance_fixed", DIST_VIEWS + f""", {POLY}, {CENTROID_LOOKUP}, {DIST},
hv AS (SELECT distance_km AS _x FROM dist WHERE distance_km IS NOT NULL AND distance_km >= 0e0
         AND distance_km <= 200 * 1e-1 + 0e0),
hk AS (SELECT _x, FLOOR((_x - 0e0) / 1e-1) AS k0 FROM hv),
hk1 AS (SELECT CASE WHEN _x < k0 * 1e-1 + 0e0 THEN k0 - 1 WHEN _x >= (k0 + 1) * 1e-1 + 0e0 THEN k0 + 1 ELSE k0 END AS k1 FROM hk),
hn AS (SELECT CASE WHEN k1 >= 200 THEN 199 ELSE k1 END AS bin, COUNT(*) AS n FROM hk1 GROUP BY 1)
SELECT CAST(g.bin AS INT) AS bin, ROUND(g.bin * 1e-1 + 0e0, 6) AS bin_lo, ROUND((g.bin + 1) * 1e-1 + 0e0, 6) AS bin_hi,
  COALESCE(hn.n, 0) AS n
FROM range(0, 200) g(bin) LEFT JOIN hn ON hn.bin = g.bin""")

_add("hist_sentiment_by_stance", with_views("fx_comments") + ", "
     + hist_sql("fx_comments", "sentiment_score", 40, ["stance"], True))

_add("hist_sentiment_by_sign", with_views("fx_comments") + """,
sg AS (SELECT council, sentiment_score, CASE WHEN sentiment_score < 0 THEN 'Negative'
         WHEN sentiment_score > 0 THEN 'Positive' WHEN sentiment_score = 0 THEN 'Neutral' END AS sign FROM fx_comments), """
     + hist_sql("sg", "sentiment_score", 20, ["council", "sign"], False))

_add("hist_distance_by_stance", DIST_VIEWS + f""", {POLY}, {CENTROID_LOOKUP}, {DIST},
ds AS (SELECT * FROM dist WHERE stance IN ({STANCES})), """ + hist_sql("ds", "distance_km", 50, ["stance"], False))

_add("kde_sentiment", with_views("fx_comments") + """,
v AS (SELECT stance AS g, sentiment_score AS x FROM fx_comments WHERE sentiment_score IS NOT NULL AND stance IS NOT NULL),
rng AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v),
st AS (SELECT g, COUNT(*) AS n, STDDEV_SAMP(x) * POW(CAST(COUNT(*) AS DOUBLE), -2e-1) AS bw FROM v GROUP BY g),
d AS (SELECT g, x, COUNT(*) AS w FROM v GROUP BY g, x),
gp AS (SELECT CAST(gi AS BIGINT) AS gi, gi * ((hi - lo) / 199e0) + lo AS gx FROM range(0, 200) t(gi) CROSS JOIN rng),
k AS (SELECT d.g, gp.gi, MAX(gp.gx) AS gx, MAX(st.n) AS n, MAX(st.bw) AS bw,
        SUM(d.w * EXP(((gp.gx - d.x) / st.bw) * ((gp.gx - d.x) / st.bw) * -5e-1)) AS k
      FROM d JOIN st ON d.g = st.g AND st.bw > 0 CROSS JOIN gp GROUP BY d.g, gp.gi)
SELECT g AS stance, CAST(gi AS INT) AS grid_index, ROUND(gx, 6) AS x,
  ROUND(k / (n * bw * SQRT(2 * PI())), 6) AS density,
  ROUND(k / (n * bw * SQRT(2 * PI())) * (n * ((SELECT hi FROM rng) - (SELECT lo FROM rng)) / 40e0), 6) AS scaled
FROM k""")

_add("kde_sentiment_binned", with_views("fx_comments") + """,
v AS (SELECT stance AS g, sentiment_score AS x FROM fx_comments WHERE sentiment_score IS NOT NULL AND stance IS NOT NULL),
rng AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM v),
st AS (SELECT g, COUNT(*) AS n, STDDEV_SAMP(x) * POW(CAST(COUNT(*) AS DOUBLE), -2e-1) AS bw FROM v GROUP BY g),
pl AS (SELECT g, (x - lo) / (hi - lo) * 1024e0 AS z FROM v CROSS JOIN rng),
split AS (SELECT g, LEAST(FLOOR(z), 1023) AS b, LEAST(FLOOR(z), 1023) + 1 - z AS w FROM pl UNION ALL SELECT g, LEAST(FLOOR(z), 1023) + 1, z - LEAST(FLOOR(z), 1023) FROM pl),
p AS (SELECT g, lo + b * ((hi - lo) / 1024e0) AS x, SUM(w) AS w FROM split CROSS JOIN rng GROUP BY g, b, lo, hi),
gp AS (SELECT gi, gi * ((hi - lo) / 199e0) + lo AS gx, hi - lo AS span FROM range(0, 200) t(gi) CROSS JOIN rng),
k AS (SELECT p.g, gp.gi, MAX(gp.gx) AS gx, MAX(span) AS span, MAX(st.n) AS n, MAX(st.bw) AS bw, SUM(p.w * EXP(((gp.gx - p.x) / st.bw) * ((gp.gx - p.x) / st.bw) * -5e-1)) AS k
      FROM p JOIN st ON p.g = st.g AND st.bw > 0 CROSS JOIN gp GROUP BY p.g, gp.gi)
SELECT g AS stance, CAST(gi AS INT) AS grid_index, ROUND(gx, 6) AS x, ROUND(k / (n * bw * SQRT(2 * PI())), 6) AS density,
  ROUND(k / (n * bw * SQRT(2 * PI())) * (n * span / 40e0), 6) AS scaled,
  ROUND((span / 1024e0) * (span / 1024e0) / (8 * SQRT(2 * PI()) * bw * bw * bw), 9) AS error
FROM k""")

_add("box_sentiment_by_topic", with_views("fx_comments", "fx_topic_names") + f""", {_MENTIONS}, {_FREQ_BASE}, {_FREQ},
top AS (SELECT topic_id, topic_group FROM freq WHERE rank < {K.TOP_TOPICS_BAR}),
src AS (SELECT l.topic AS topic_id, c.sentiment_score FROM fx_topic_long l JOIN fx_comments c USING (comment_id)
        WHERE l.topic IN (SELECT topic_id FROM top)), """ + box_sql("src", "sentiment_score", ["topic_id"]) + """
SELECT box.*, top.topic_group FROM box JOIN top USING (topic_id)""")

_add("box_distance_by_topic", with_views("fx_pld", "fx_vertex", "fx_comments", "fx_topic_names")
     + f""", {POLY}, {CENTROID_LOOKUP}, {DIST},
dl AS (SELECT d.comment_id, d.distance_km, l.topic FROM dist d JOIN fx_topic_long l USING (comment_id)),
top AS (SELECT topic FROM dl GROUP BY topic ORDER BY COUNT(*) DESC, topic LIMIT {K.TOP_TOPICS_DISTANCE}),
src AS (SELECT DISTINCT comment_id, topic AS topic_id, distance_km FROM dl WHERE topic IN (SELECT topic FROM top)), """
     + box_sql("src", "distance_km", ["topic_id"]) + """
SELECT box.*, COALESCE(n.topic_group, 'Topic ' || CAST(box.topic_id AS VARCHAR)) AS label
FROM box LEFT JOIN fx_topic_names n ON n.Topic = box.topic_id""")

_add("box_distance_by_housing", DIST_VIEWS + f""", {POLY}, {CENTROID_LOOKUP}, {DIST},
src AS (SELECT housing_type, distance_km FROM dist WHERE housing_type IS NOT NULL), """
     + box_sql("src", "distance_km", ["housing_type"]) + "\nSELECT * FROM box")

_add("box_comments_by_housing", with_views("fx_applications") + """,
src AS (SELECT housing_type, comment_count FROM fx_applications WHERE housing_type IS NOT NULL), """
     + box_sql("src", "comment_count", ["housing_type"]) + "\nSELECT * FROM box")

_add("box_sentiment_by_housing", with_views("fx_comments", "fx_applications") + """,
src AS (SELECT a.housing_type, c.sentiment_score FROM fx_comments c
        LEFT JOIN fx_applications a ON c.application_id = a.lpa_app_no WHERE a.housing_type IS NOT NULL), """
     + box_sql("src", "sentiment_score", ["housing_type"]) + "\nSELECT * FROM box")

_add("regression_by_housing", with_views("fx_applications") + f"""
SELECT housing_type, COUNT(*) AS n, CAST(REGR_COUNT(y, xs) AS BIGINT) AS n_fit, ROUND(REGR_SLOPE(y, xs), 6) AS slope,
  ROUND(REGR_INTERCEPT(y, xs), 6) AS intercept
FROM (SELECT housing_type, CAST(comment_count AS DOUBLE) AS y,
        CASE WHEN housing_type <> 'Other' THEN CAST(total_no_proposed_residential_units AS DOUBLE) END AS xs
      FROM fx_applications WHERE housing_type IN ({HOUSING})) t
GROUP BY housing_type""")

def _band_sql(replicates: int = 1000, grid: int = 100) -> str:
    """The bootstrap band on rows for pairs and replicates; weights by the arithmetic of operators.regression."""
    p = RG.PRIME
    key = lambda v: f"(CAST(FLOOR({v}) AS BIGINT) % {p} * 1048583 + CAST(FLOOR(({v} - FLOOR({v})) * 1048576e0) AS BIGINT)) % {p}"
    linear = lambda k: "({} * kx % {p} + {} * ky % {p} + {} * r % {p} + ({} * j + {}) % {p})".format(*RG.FACTORS[k][:4], RG.FACTORS[k][5], p=p)
    fifth = lambda t: f"({t} * {t} % {p}) * ({t} * {t} % {p}) % {p} * {t} % {p}"
    table = "[" + ", ".join(str(RG.poisson_thresholds(c)) for c in range(1, RG.SMALL + 1)) + "]"
    return with_views("fx_applications") + f""",
v AS (SELECT housing_type AS g, CAST(total_no_proposed_residential_units AS DOUBLE) AS x, CAST(comment_count AS DOUBLE) AS y FROM fx_applications
      WHERE housing_type IN ({HOUSING}) AND housing_type <> 'Other' AND total_no_proposed_residential_units IS NOT NULL AND comment_count IS NOT NULL),
pairs AS (SELECT g, x, y, COUNT(*) AS c, {key("x")} AS kx, {key("y")} AS ky FROM v GROUP BY g, x, y),
draw AS (SELECT *, UNNEST(RANGE(CASE WHEN c > {RG.SMALL} THEN {RG.DRAWS} ELSE 1 END)) AS j FROM pairs, RANGE({replicates}) t(r)),
one AS (SELECT *, {linear(0)} % {p} AS t FROM draw),
two AS (SELECT *, ({linear(1)} + ({fifth("t")}) * 16807 % {p}) % {p} AS s FROM one),
u AS (SELECT g, x, y, c, r, j, {fifth("s")} AS u FROM two),
w AS (SELECT g, x, y, r, CASE WHEN c <= {RG.SMALL} THEN LEN(LIST_FILTER(TB.t[c], LAMBDA q: q <= SUM(u)))
        ELSE GREATEST(0e0, FLOOR(c + SQRT(c) * ((SUM(u) + {RG.DRAWS / 2}::DOUBLE) / {p}e0 - {RG.DRAWS / 2}::DOUBLE) + 5e-1)) END::DOUBLE AS w
      FROM u, (SELECT {table} AS t) TB GROUP BY g, x, y, c, r, TB.t),
s AS (SELECT g, r, SUM(w) AS n, SUM(w * x) AS sx, SUM(w * y) AS sy, SUM(w * x * x) AS sxx, SUM(w * x * y) AS sxy FROM w GROUP BY g, r
      UNION ALL SELECT g, -1, COUNT(*)::DOUBLE, SUM(x), SUM(y), SUM(x * x), SUM(x * y) FROM v GROUP BY g),
m AS (SELECT g, r, n, sx, sy, (n * sxy - sx * sy) / NULLIF(n * sxx - sx * sx, 0) AS m FROM s),
ends AS (SELECT g, MIN(x) AS lo, MAX(x) AS hi FROM v GROUP BY g),
pts AS (SELECT g, r, gi, lo + (hi - lo) / {grid - 1}e0 * gi AS x, m, (sy - m * sx) / n AS c FROM m JOIN ends USING (g), RANGE({grid}) t(gi) WHERE m IS NOT NULL),
line AS (SELECT g, r, gi, x, m * x + c AS yh FROM pts)
SELECT g AS housing_type, CAST(gi AS INT) AS grid_index, ROUND(ANY_VALUE(x), 6) AS x, ROUND(MAX(yh) FILTER (r < 0), 6) AS yhat,
  ROUND(QUANTILE_CONT(yh, 25e-3) FILTER (r >= 0), 6) AS lo, ROUND(QUANTILE_CONT(yh, 975e-3) FILTER (r >= 0), 6) AS hi
FROM line GROUP BY g, gi HAVING COUNT(*) FILTER (r < 0) > 0"""


_add("regression_bootstrap_band", _band_sql())

# -- demographics (Q5) -----------------------------------------------------------------
_LSOA_JOIN = f""", {_CENSUS},
ed AS (
  SELECT lsoa_code, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM fx_lsoa UNION ALL
  SELECT lsoa_code, x2, y2, x3, y3 FROM fx_lsoa UNION ALL
  SELECT lsoa_code, x3, y3, x4, y4 FROM fx_lsoa UNION ALL
  SELECT lsoa_code, x4, y4, x1, y1 FROM fx_lsoa),
edc AS (SELECT * FROM ed WHERE lsoa_code IN (SELECT lsoa_code FROM cen)),
pts AS (SELECT comment_id, lon AS px, lat AS py FROM fx_comments WHERE lat IS NOT NULL AND lon IS NOT NULL),
cr AS (SELECT p.comment_id, e.lsoa_code, COUNT(*) AS k FROM pts p JOIN edc e
         ON ((e.ay > p.py) <> (e.by_ > p.py)) AND p.px < (e.bx - e.ax) * (p.py - e.ay) / (e.by_ - e.ay) + e.ax
       GROUP BY 1, 2),
mt AS (SELECT comment_id, MIN(lsoa_code) AS lsoa_code FROM cr WHERE k % 2 = 1 GROUP BY 1),
cl5 AS (SELECT c.comment_id, mt.lsoa_code, cen.percent_age_50_plus, cen.percent_occupation_1_2_3, cen.percent_owned_total
        FROM fx_comments c LEFT JOIN mt USING (comment_id) LEFT JOIN cen ON cen.lsoa_code = mt.lsoa_code),
prof AS (SELECT lsoa_code, COUNT(comment_id) AS num_comments, AVG(percent_age_50_plus) AS percent_age_50_plus,
           AVG(percent_occupation_1_2_3) AS percent_occupation_1_2_3, AVG(percent_owned_total) AS percent_owned_total
         FROM cl5 WHERE lsoa_code IS NOT NULL GROUP BY lsoa_code),
lg AS (SELECT lsoa_code, num_comments, 'percent_age_50_plus' AS variable, percent_age_50_plus AS x FROM prof UNION ALL
       SELECT lsoa_code, num_comments, 'percent_occupation_1_2_3', percent_occupation_1_2_3 FROM prof UNION ALL
       SELECT lsoa_code, num_comments, 'percent_owned_total', percent_owned_total FROM prof)"""
_LVIEWS = with_views("fx_comments", "fx_lsoa", "fx_census")

_add("lsoa_spatial_join", _LVIEWS + _LSOA_JOIN + "\nSELECT comment_id, lsoa_code FROM cl5")

_add("lsoa_profile", _LVIEWS + _LSOA_JOIN + """
SELECT lsoa_code, num_comments, ROUND(percent_age_50_plus, 6) AS percent_age_50_plus,
  ROUND(percent_occupation_1_2_3, 6) AS percent_occupation_1_2_3, ROUND(percent_owned_total, 6) AS percent_owned_total
FROM prof""")

_add("lsoa_regression", _LVIEWS + _LSOA_JOIN + """
SELECT variable, CAST(REGR_COUNT(y, x) AS BIGINT) AS n_fit, ROUND(REGR_SLOPE(y, x), 6) AS slope,
  ROUND(REGR_INTERCEPT(y, x), 6) AS intercept, response
FROM (SELECT variable, x, CAST(num_comments AS DOUBLE) AS y, 'raw' AS response FROM lg UNION ALL
      SELECT variable, x, LN(1 + num_comments), 'log1p' FROM lg) t
GROUP BY variable, response""")

_add("lsoa_correlation", _LVIEWS + _LSOA_JOIN + """,
pr AS (SELECT variable, response, COUNT(*) AS n, COVAR_POP(x, y) AS c, STDDEV_POP(x) AS sx, STDDEV_POP(y) AS sy
       FROM (SELECT variable, x, CAST(num_comments AS DOUBLE) AS y, 'raw' AS response FROM lg UNION ALL
             SELECT variable, x, LN(1 + num_comments), 'log1p' FROM lg) t
       WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY variable, response),
rr AS (SELECT *, CASE WHEN n >= 2 AND sx * sy <> 0 THEN c / (sx * sy) END AS r FROM pr)
SELECT variable, n, ROUND(r, 6) AS r,
  ROUND(r * SQRT(CASE WHEN 1 - r * r = 0 THEN NULL ELSE (n - 2) / (1 - r * r) END), 6) AS t, response
FROM rr""")

_add("welch_test", _LVIEWS + _LSOA_JOIN + """,
wc AS (SELECT * FROM cen WHERE lsoa_code IN (SELECT lsoa_code FROM cl5 WHERE lsoa_code IS NOT NULL)),
wl AS (SELECT 'percent_age_50_plus' AS variable, percent_age_50_plus AS x, 'a' AS grp FROM cen UNION ALL
       SELECT 'percent_occupation_1_2_3', percent_occupation_1_2_3, 'a' FROM cen UNION ALL
       SELECT 'percent_owned_total', percent_owned_total, 'a' FROM cen UNION ALL
       SELECT 'percent_age_50_plus', percent_age_50_plus, 'b' FROM wc UNION ALL
       SELECT 'percent_occupation_1_2_3', percent_occupation_1_2_3, 'b' FROM wc UNION ALL
       SELECT 'percent_owned_total', percent_owned_total, 'b' FROM wc),
ws AS (SELECT variable,
         COUNT(x) FILTER (WHERE grp = 'a') AS n_a, AVG(x) FILTER (WHERE grp = 'a') AS m_a, VAR_SAMP(x) FILTER (WHERE grp = 'a') AS v_a,
         COUNT(x) FILTER (WHERE grp = 'b') AS n_b, AVG(x) FILTER (WHERE grp = 'b') AS m_b, VAR_SAMP(x) FILTER (WHERE grp = 'b') AS v_b
       FROM wl GROUP BY variable),
wq AS (SELECT *, v_a / n_a AS qa, v_b / n_b AS qb FROM ws)
SELECT variable, n_a, n_b, ROUND((m_a - m_b) / SQRT(qa + qb), 6) AS t,
  ROUND((qa + qb) * (qa + qb) / (qa * qa / (n_a - 1) + qb * qb / (n_b - 1)), 6) AS df
FROM wq""")

_add("hist_census_feature", _LVIEWS + _LSOA_JOIN + """,
cv AS (SELECT 'percent_age_50_plus' AS variable, percent_age_50_plus AS value FROM cl5 UNION ALL
       SELECT 'percent_occupation_1_2_3', percent_occupation_1_2_3 FROM cl5 UNION ALL
       SELECT 'percent_owned_total', percent_owned_total FROM cl5), """ + hist_sql("cv", "value", 30, ["variable"], False))


# -- two-sided p of Student's t: Simpson's rule over the density, 4000 steps ---------------
def _with_p(name: str, cut: str, t: str, df: str, columns: str) -> str:
    """The oracle `name` up to its final SELECT, whose statistic t has df degrees of freedom, with p."""
    body = ORACLE[name]
    head = body[: body.rindex(cut)]
    table = body[body.rindex("FROM "):].split()[1]
    return head + f""",
st AS (SELECT *, {t} AS t_, {df} AS df_ FROM {table}),
pp AS (SELECT st.*, 1 - 2 * (SELECT SUM((CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
    * POWER(1 + POWER(ABS(t_) * k / 4000, 2) / df_, -(df_ + 1) / 2)) * ABS(t_) / 12000
    * EXP(LGAMMA((df_ + 1) / 2) - LGAMMA(df_ / 2)) / SQRT(df_ * PI()) FROM range(4001) r(k)) AS p_ FROM st)
SELECT {columns}, ROUND(GREATEST(p_, 0), 6) AS p FROM pp"""


_add("lsoa_correlation_p", _with_p(
    "lsoa_correlation", "\nSELECT variable, n,", "r * SQRT(CASE WHEN 1 - r * r = 0 THEN NULL ELSE (n - 2) / (1 - r * r) END)", "CAST(n - 2 AS DOUBLE)",
    "variable, n, ROUND(r, 6) AS r, ROUND(t_, 6) AS t, response"))
_add("welch_test_p", _with_p(
    "welch_test", "\nSELECT variable, n_a,", "(m_a - m_b) / SQRT(qa + qb)", "(qa + qb) * (qa + qb) / (qa * qa / (n_a - 1) + qb * qb / (n_b - 1))",
    "variable, n_a, n_b, ROUND(t_, 6) AS t, ROUND(df_, 6) AS df"))

# -- tables behind the figures -----------------------------------------------------------
_add("housing_type_shares", with_views("fx_applications") + f"""
SELECT housing_type, COUNT(*) AS n, CAST(SUM(COALESCE(total_no_proposed_residential_units, 0)) AS BIGINT) AS units,
  CAST(ROUND(CAST(AVG(comment_count) AS DECIMAL(18, 9)), 2) AS DOUBLE) AS mean_comments, ROUND(COUNT(*) / SUM(COUNT(*)) OVER () * 1e2, 6) AS pct
FROM fx_applications WHERE housing_type IN ({HOUSING}) GROUP BY housing_type""")

_add("borough_top_applications", with_views("fx_applications") + f"""
SELECT lpa_app_no, LOWER(REPLACE(borough, ' ', '_')) AS file_name,
  array_to_string(list_transform(string_split(housing_type, ' '), lambda w: UPPER(w[1]) || LOWER(w[2:])), ' ') AS heading,
  lpa_app_no || ': ' || comment_count || ' comments' AS caption
FROM fx_applications WHERE borough = {B} ORDER BY comment_count DESC, lpa_app_no LIMIT 10""")

_add("busiest_councils", with_views("fx_comments") + """
SELECT council, COUNT(*) AS n FROM fx_comments WHERE council IS NOT NULL GROUP BY council ORDER BY n DESC, council LIMIT 5""")

_add("map_points", with_views("fx_vertex", "fx_comments") + """
SELECT comment_id, CAST(NULL AS VARCHAR) AS lpa_app_no, CAST(NULL AS VARCHAR) AS borough, lat, lon FROM fx_comments
WHERE lat IS NOT NULL AND lon IS NOT NULL
UNION ALL SELECT NULL, lpa_app_no, borough, y, x FROM fx_vertex WHERE pos = 0""")

_add("comments_with_application_key", with_views("fx_comments", "fx_pld") + """
SELECT c.comment_id, c.application_id || '_' || c.council AS app_key, p.housing_type
FROM fx_comments c LEFT JOIN fx_pld p ON c.application_id || '_' || c.council = p.lpa_app_no || '_' || p.borough""")

_add("comment_preview", with_views("fx_comments") + """
SELECT comment_id, application_id, stance FROM fx_comments ORDER BY comment_id LIMIT 5""")


# -- X5 forward projection, staged as nested selects (mirrors operators/geometry.with_bng) ---
def _bng_sql(keys: str = "comment_id", source: str = "fx_comments", lat: str = "lat", lon: str = "lon", digits: int | None = 3) -> str:
    import math

    from civiclens.functions import geo as X

    def d(v: float) -> str:
        r = repr(float(v))
        return f"({r}e0)" if ("e" not in r and "inf" not in r and "nan" not in r) else f"({r})"

    def cart(lat: str, lon: str, a: float, b: float, rest: str) -> str:
        e2 = 1 - (b * b) / (a * a)
        nu = f"({d(a)} / SQRT((1 - (({d(e2)} * SIN({lat})) * SIN({lat})))))"
        return (f"SELECT {rest}, (({nu} * COS({lat})) * COS({lon})) AS cx, "
                f"(({nu} * COS({lat})) * SIN({lon})) AS cy, (({nu} * {d(1 - e2)}) * SIN({lat})) AS cz")

    s = 1.0 * X.HELMERT_S_PPM * 1e-6
    k = 1.0 * math.pi / (180 * 3600)
    rx, ry, rz = X.HELMERT_RX * k, X.HELMERT_RY * k, X.HELMERT_RZ * k
    c1 = 1 + s
    a_, b_ = X.AIRY_A, X.AIRY_B
    e2a = 1 - (b_ * b_) / (a_ * a_)
    stages = [f"SELECT {keys}, RADIANS({lat}) AS rl, RADIANS({lon}) AS rn FROM {source}"]
    stages.append(cart("rl", "rn", X.GRS80_A, X.GRS80_B, keys))
    stages.append(f"SELECT {keys}, (((((cx * {d(c1)}) - (cy * {d(rz)})) + (cz * {d(ry)})) + {d(X.HELMERT_TX)})) AS hx, "
                  f"(((((cx * {d(rz)}) + (cy * {d(c1)})) - (cz * {d(rx)})) + {d(X.HELMERT_TY)})) AS hy, "
                  f"((((((-(cx)) * {d(ry)}) + (cy * {d(rx)})) + (cz * {d(c1)})) + {d(X.HELMERT_TZ)})) AS hz")
    stages.append(f"SELECT {keys}, hx, hy, hz, SQRT(((hx * hx) + (hy * hy))) AS p")
    stages.append(f"SELECT {keys}, hx, hy, hz, p, ATAN2(hz, (p * {d(1 - e2a)})) AS l0")
    for i in range(5):
        si = f"SIN(l{i})"
        stages.append(f"SELECT {keys}, hx, hy, hz, p, ATAN2((hz + (({d(e2a)} * ({d(a_)} / SQRT((1 - "
                      f"(({d(e2a)} * {si}) * {si}))))) * {si})), p) AS l{i + 1}")
    f0 = X.NG_F0
    n_ = (a_ - b_) / (a_ + b_)
    phi0 = math.radians(X.NG_LAT0)
    k1 = 1 + n_ + 1.25 * n_ ** 2 + 1.25 * n_ ** 3
    k2 = 3 * n_ + 3 * n_ ** 2 + 21 / 8 * n_ ** 3
    k3 = 15 / 8 * n_ ** 2 + 15 / 8 * n_ ** 3
    k4 = 35 / 24 * n_ ** 3
    dd, ss = f"(phi - {d(phi0)})", f"(phi + {d(phi0)})"
    m = (f"({d(b_ * f0)} * (((({d(k1)} * {dd}) - (({d(k2)} * SIN({dd})) * COS({ss}))) + "
         f"(({d(k3)} * SIN((2 * {dd}))) * COS((2 * {ss})))) - (({d(k4)} * SIN((3 * {dd}))) * COS((3 * {ss})))))")
    stages.append(f"SELECT {keys}, l5 AS phi, ATAN2(hy, hx) AS lam")
    stages.append(f"SELECT {keys}, SIN(phi) AS sp, COS(phi) AS cp, TAN(phi) AS tp, {m} AS m, "
                  f"(lam - {d(math.radians(X.NG_LON0))}) AS dl")
    stages.append(f"SELECT *, ({d(a_ * f0)} / SQRT((1 - (({d(e2a)} * sp) * sp)))) AS nu, "
                  f"({d(a_ * f0 * (1 - e2a))} * POW((1 - (({d(e2a)} * sp) * sp)), {d(-1.5)})) AS rho")
    stages.append("SELECT *, ((nu / rho) - 1) AS eta2")
    stages.append(f"SELECT {keys}, dl, (m + {d(X.NG_N0)}) AS i1, (((nu / 2) * sp) * cp) AS i2, "
                  "((((nu / 24) * sp) * POW(cp, 3)) * ((5 - (tp * tp)) + (9 * eta2))) AS i3, "
                  "((((nu / 720) * sp) * POW(cp, 5)) * ((61 - ((58 * tp) * tp)) + POW(tp, 4))) AS i3a, "
                  "(nu * cp) AS i4, (((nu / 6) * POW(cp, 3)) * ((nu / rho) - (tp * tp))) AS i5, "
                  "(((nu / 120) * POW(cp, 5)) * ((((5 - ((18 * tp) * tp)) + POW(tp, 4)) + (14 * eta2)) "
                  "- (((58 * tp) * tp) * eta2))) AS i6")
    r = (lambda x: f"ROUND({x}, {digits})") if digits is not None else str
    east = f"((({d(X.NG_E0)} + (i4 * dl)) + (i5 * POW(dl, 3))) + (i6 * POW(dl, 5)))"
    north = "(((i1 + (i2 * POW(dl, 2))) + (i3 * POW(dl, 4))) + (i3a * POW(dl, 6)))"
    stages.append(f"SELECT {keys}, {r(east)} AS bng_e, {r(north)} AS bng_n")
    sql = stages[0]
    for st in stages[1:]:
        sql = f"{st} FROM ({sql}) t"
    return sql


_add("comment_points_bng", with_views("fx_comments") + _bng_sql())


def _wgs84_sql(keys: str, source: str) -> str:
    """National Grid (e, n) of the source to WGS84 (lat, lon), iterations unrolled."""
    import math

    from civiclens.functions import geo as X

    d = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    a, b, f0 = X.AIRY_A, X.AIRY_B, X.NG_F0
    e2 = 1 - (b * b) / (a * a)
    n = (a - b) / (a + b)
    phi0 = math.radians(X.NG_LAT0)
    factors = (1 + n + 1.25 * n ** 2 + 1.25 * n ** 3, 3 * n + 3 * n ** 2 + 21 / 8 * n ** 3, 15 / 8 * n ** 2 + 15 / 8 * n ** 3, 35 / 24 * n ** 3)

    def arc(p: str) -> str:
        dd, ss = f"({p} - {d(phi0)})", f"({p} + {d(phi0)})"
        k = [d(v) for v in factors]
        return (f"{d(b * f0)} * ({k[0]} * {dd} - {k[1]} * SIN({dd}) * COS({ss}) + {k[2]} * SIN(2 * {dd}) * COS(2 * {ss}) "
                f"- {k[3]} * SIN(3 * {dd}) * COS(3 * {ss}))")

    north = f"(n - {d(X.NG_N0)})"
    stages = [f"SELECT {keys}, e, n, {d(phi0)} + {north} / {d(a * f0)} AS p FROM {source}"]
    stages += [f"SELECT {keys}, e, n, p + ({north} - {arc('p')}) / {d(a * f0)} AS p"] * 6
    stages.append(f"SELECT {keys}, p, TAN(p) AS t, COS(p) AS c, e - {d(X.NG_E0)} AS de, {d(a * f0)} / SQRT(1 - {d(e2)} * SIN(p) * SIN(p)) AS nu, "
                  f"{d(a * f0 * (1 - e2))} * POW(1 - {d(e2)} * SIN(p) * SIN(p), -15e-1) AS rho")
    stages.append("SELECT *, nu / rho - 1 AS eta")
    stages.append(
        f"SELECT {keys}, p - t / (2 * rho * nu) * de ** 2 + t / (24 * rho * nu ** 3) * (5 + 3 * t * t + eta - 9 * t * t * eta) * de ** 4 "
        f"- t / (720 * rho * nu ** 5) * (61 + 90 * t * t + 45 * t ** 4) * de ** 6 AS la, "
        f"{d(math.radians(X.NG_LON0))} + de / (c * nu) - de ** 3 / (c * 6 * nu ** 3) * (nu / rho + 2 * t * t) "
        f"+ de ** 5 / (c * 120 * nu ** 5) * (5 + 28 * t * t + 24 * t ** 4) - de ** 7 / (c * 5040 * nu ** 7) * (61 + 662 * t * t + 1320 * t ** 4 + 720 * t ** 6) AS lo")
    nu = f"{d(a)} / SQRT(1 - {d(e2)} * SIN(la) * SIN(la))"
    stages.append(f"SELECT {keys}, {nu} * COS(la) * COS(lo) AS x, {nu} * COS(la) * SIN(lo) AS y, {nu} * {d(1 - e2)} * SIN(la) AS z")
    s, k = -X.HELMERT_S_PPM * 1e-6, -math.pi / (180 * 3600)
    rx, ry, rz = (d(v * k) for v in (X.HELMERT_RX, X.HELMERT_RY, X.HELMERT_RZ))
    stages.append(f"SELECT {keys}, x * {d(1 + s)} - y * {rz} + z * {ry} - {d(X.HELMERT_TX)} AS x, x * {rz} + y * {d(1 + s)} - z * {rx} - {d(X.HELMERT_TY)} AS y, "
                  f"y * {rx} - x * {ry} + z * {d(1 + s)} - {d(X.HELMERT_TZ)} AS z")
    g2 = 1 - (X.GRS80_B * X.GRS80_B) / (X.GRS80_A * X.GRS80_A)
    stages.append(f"SELECT {keys}, x, y, z, SQRT(x * x + y * y) AS q, ATAN2(z, SQRT(x * x + y * y) * {d(1 - g2)}) AS l")
    stages += [f"SELECT {keys}, x, y, z, q, ATAN2(z + {d(g2)} * ({d(X.GRS80_A)} / SQRT(1 - {d(g2)} * SIN(l) * SIN(l))) * SIN(l), q) AS l"] * 5
    sql = stages[0]
    for st in stages[1:]:
        sql = f"{st} FROM ({sql}) t"
    return f"SELECT {keys}, DEGREES(l) AS cy, DEGREES(ATAN2(y, x)) AS cx FROM ({sql}) t"


_KEYS = "lpa_app_no, borough, src_ord"
_POLY_BNG = POLY.replace("fx_vertex", "grid_vertex")  # the same polygons with projected vertices
_add("comments_with_centroid_bng", DIST_VIEWS + f""",
grid_vertex AS (SELECT {_KEYS}, pos, bng_e AS x, bng_n AS y FROM ({_bng_sql(_KEYS + ", pos", "fx_vertex", "y", "x", None)}) t),
{_POLY_BNG.replace("area_c AS", "grid_c AS")},
area_c AS ({_wgs84_sql(_KEYS, f"(SELECT {_KEYS}, cx AS e, cy AS n FROM grid_c)")}),
{CENTROID_LOOKUP}, {DIST}
SELECT comment_id, ROUND(app_lat, 6) AS app_lat, ROUND(app_lon, 6) AS app_lon, ROUND(distance_km, 6) AS distance_km FROM dist""")
