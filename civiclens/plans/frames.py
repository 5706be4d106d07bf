"""Intermediate frames shared by several analyses, built from `Fixtures`-shaped
inputs (comments, comments_with_topics, topic_names, pld, applications, lsoa,
census sheets). Each function is lazy and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens import constants as K
from civiclens.functions.geo import haversine_km
from civiclens.operators import geometry as GM
from civiclens.functions.lists import contains, parse_double_list, parse_int_list, primary_topic, rejected
from civiclens.functions.scalar import percent, row_sum
from civiclens.operators.relational import coverage_report, exists_flag, keep_first, lookup, semi_join, union_fill

COORDS = "`wgs84_polygon.coordinates`"


def topic_lists(comments_with_topics: DataFrame) -> DataFrame:
    """comments_with_topics with `topic_list` parsed (missing stays NULL)."""
    return comments_with_topics.withColumn("topic_list", parse_int_list("topic_number"))


# -- applications and centroids ------------------------------------------------------
def build_applications(pld: DataFrame, comments: DataFrame) -> DataFrame:
    """Applications with their comment count (0 when none). The count is a partial
    aggregate, so an application with a third of all comments costs one row per task."""
    counts = comments.groupBy("application_id").agg(F.count("*").alias("_n"))
    return (pld.join(counts, F.col("lpa_app_no") == F.col("application_id"), "left")
            .select("lpa_app_no", "borough", "housing_type", "total_no_proposed_residential_units",
                    F.coalesce(F.col("_n"), F.lit(0)).alias("comment_count")))


def application_centroids(pld: DataFrame, method: str = "planar") -> DataFrame:
    """X1 + X2/X4 + W1: one centroid per application number (first in source order)
    among valid polygons. method: "bng" (area centroid in the National Grid, as the
    original analysis), "planar" (area centroid in lon/lat), "vertex_mean" (X3)."""
    # a pld without an explicit source order is ordered by its own columns
    order = F.col("src_ord") if "src_ord" in pld.columns else F.xxhash64("borough", F.to_json(F.struct(F.col(COORDS).alias("c"))))
    base = pld.where(F.col(COORDS).isNotNull()).select("lpa_app_no", "borough", order.alias("src_ord"), COORDS)
    if method == "vertex_mean":
        c = GM.with_vertex_mean(base.withColumn("_ring", F.get(F.col(COORDS), 0)), "_ring",
                                "centroid_lat", "centroid_lon")
    elif method == "bng":
        c = GM.with_area_centroid_bng(GM.with_outer_ring(base, COORDS), "_ring", "centroid_lat", "centroid_lon")
    else:
        c = GM.with_area_centroid(GM.with_outer_ring(base, COORDS), "_ring", "centroid_lon", "centroid_lat")
    # "drop missing centroids, then first per application" as one window: rows without
    # a centroid sort last and are removed after the window. Filtering before the
    # window would let the optimizer copy the centroid expression into the filter.
    missing = F.col("centroid_lat").isNull() | F.col("centroid_lon").isNull()
    cent = c.select("lpa_app_no", "borough", "src_ord", "centroid_lat", "centroid_lon")
    first = keep_first(cent, "lpa_app_no", [missing.asc(), F.col("src_ord").asc()])
    return first.where(F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull()).drop("src_ord")


def comment_distances(comments: DataFrame, topic_text: DataFrame, pld: DataFrame,
                      centroid_method: str = "planar", with_topics: bool = True) -> DataFrame:
    """Q4 base frame: comments + topic lists (J1) + housing type on (application,
    borough) (J2, pld duplicates fan out) + application centroid on (application,
    borough) (J3) + haversine distance (X6).

    The topic table has one row per comment, so `with_topics=False` (for analyses
    that do not use the lists) gives the same rows without that join's shuffle.
    pld and the centroids, both of the applications' size, are joined first; the comments
    then take part in one join, whose hot applications AQE can split."""
    df = comments
    if with_topics:
        tp = topic_text.select("comment_id", "topic_number", "probability")
        df = df.join(tp, "comment_id", "left")
        df = df.withColumns({"topic_list": parse_int_list("topic_number"),
                             "prob_list": parse_double_list("probability")})
    p = pld.select(F.col("lpa_app_no").alias("_pa"), F.col("borough").alias("_pb"), "housing_type",
                   "total_no_proposed_residential_units")
    cen = application_centroids(pld, centroid_method).select(
        F.col("lpa_app_no").alias("_ca"), F.col("borough").alias("_cb"),
        F.col("centroid_lat").alias("app_lat"), F.col("centroid_lon").alias("app_lon"))
    # every centroid stands on a pld row of its own key, so a left join loses none
    p = p.join(cen, (F.col("_pa") == F.col("_ca")) & (F.col("_pb") == F.col("_cb")), "left").drop("_ca", "_cb")
    df = df.join(p, (F.col("application_id") == F.col("_pa")) & (F.col("council") == F.col("_pb")), "left") \
           .drop("_pa", "_pb")
    return df.withColumn("distance_km", haversine_km("lat", "lon", "app_lat", "app_lon"))


# -- census and LSOAs ------------------------------------------------------------------
def census_features(age: DataFrame, occ: DataFrame, ten: DataFrame,
                    age_cols: Sequence[str] = K.CENSUS_AGE_50_PLUS, age_total: str = K.CENSUS_AGE_TOTAL,
                    occ_cols: Sequence[str] = K.CENSUS_OCCUPATION_1_2_3,
                    occ_total: str = K.CENSUS_OCCUPATION_TOTAL,
                    own_cols: Sequence[str] = K.CENSUS_OWNED, hh_total: str = K.CENSUS_HOUSEHOLDS_TOTAL,
                    key: str = "LSOA code") -> DataFrame:
    """P13 + P14 + J6: the three census shares per LSOA, age left-joined to
    occupation and tenure. A zero denominator gives NULL."""
    q = lambda c: F.col(f"`{c}`")
    a = age.select(q(key).alias("lsoa_code"),
                   percent(row_sum([q(c) for c in age_cols]), q(age_total)).alias("percent_age_50_plus"))
    o = occ.select(q(key).alias("lsoa_code"),
                   percent(row_sum([q(c) for c in occ_cols]), q(occ_total)).alias("percent_occupation_1_2_3"))
    t = ten.select(q(key).alias("lsoa_code"),
                   percent(row_sum([q(c) for c in own_cols]), q(hh_total)).alias("percent_owned_total"))
    # Census tables have one row per LSOA (tens of thousands): AQE broadcasts them
    # after measuring.
    return a.join(o, "lsoa_code", "left").join(t, "lsoa_code", "left")


def comment_lsoa_codes(comments: DataFrame, lsoa: DataFrame, census: DataFrame,
                       code: str = "LSOA21CD", rings: str | None = None) -> DataFrame:
    """Boundaries restricted to census LSOAs (J7), comments joined to the containing
    LSOA (J8): every comment row with `lsoa_code` (NULL when outside all). The boundaries are as
    `read_geojson` gives them (parts) or with all rings in `rings`; comments are projected when the boundaries'
    reference system is another one."""
    from civiclens.operators.spatial import spatial_join
    rings = rings or ("rings" if "rings" in lsoa.columns else "parts")
    polys = semi_join(lsoa, census, code, "lsoa_code")
    return spatial_join(comments, polys, x="lon", y="lat", code=code, rings=rings, out="lsoa_code")


def comments_with_lsoa(comments: DataFrame, lsoa: DataFrame, census: DataFrame,
                       code: str = "LSOA21CD", rings: str | None = None) -> DataFrame:
    """Q5 base frame: `comment_lsoa_codes` with the census shares attached."""
    return comment_lsoa_codes(comments, lsoa, census, code, rings).join(census, "lsoa_code", "left")


# -- borough report (Q6) -----------------------------------------------------------------
def borough_frames(comments: DataFrame, pld: DataFrame, topic_text: DataFrame, names: DataFrame,
                   borough: str, topic_id: int) -> dict[str, DataFrame]:
    """The frames behind the four borough maps: comments of the borough with the
    application centroid (vertex mean, X3), primary topic with label and colour
    (A5 + P11), highlight flag (J9), and the application sets (J7)."""
    bc = comments.where(F.col("council") == F.lit(borough))
    bp = pld.where(F.col("borough") == F.lit(borough))
    apps = application_centroids(bp, "vertex_mean").select("lpa_app_no", "centroid_lat", "centroid_lon")
    bc = bc.join(apps.withColumnRenamed("lpa_app_no", "_a"), F.col("application_id") == F.col("_a"), "left").drop("_a")
    ct = topic_text.select("comment_id", "topic_number", parse_int_list("topic_number").alias("_parsed"))
    ct = ct.select("comment_id", rejected("topic_number", "_parsed").alias("topic_rejected"), F.coalesce("_parsed", F.array().cast("array<int>")).alias("topic_list"))
    ct = ct.select("comment_id", "topic_rejected", "topic_list", primary_topic("topic_list").alias("primary_topic"))
    bc = bc.join(ct, "comment_id", "left")
    bc = lookup(bc, "primary_topic", names, "topic_id", {"color": "topic_color", "topic_group": "topic_label"},
                {"topic_color": F.lit(K.UNCLASSIFIED_COLOR), "topic_label": F.lit(K.UNCLASSIFIED_LABEL)})
    hl = ct.where(contains("topic_list", topic_id)).select("comment_id")
    bc = exists_flag(bc, hl, "comment_id", "comment_id", "is_highlight")
    commented = semi_join(apps, bc, "lpa_app_no", "application_id")
    highlight_apps = semi_join(apps, bc.where("is_highlight"), "lpa_app_no", "application_id")
    linked = bc.na.drop(subset=["lat", "lon", "centroid_lat", "centroid_lon"])
    return {"comments": bc, "apps": apps, "apps_commented": commented,
            "apps_highlight": highlight_apps, "linked": linked}


def borough_coverage(comments: DataFrame, apps: DataFrame) -> DataFrame:
    """G11 of the borough maps in one aggregate: a borough's comments and, of its applications, all, those with
    comments and those with highlighted ones."""
    place = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    app_place = F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull()
    c = comments.select(F.lit(True).alias("comment"), place.alias("place"), F.col("primary_topic").isNotNull().alias("topic"), F.col("is_highlight").alias("highlight"),
                        (place & app_place).alias("linkable"))
    per_app = comments.where(F.col("application_id").isNotNull()).groupBy("application_id").agg(F.max("is_highlight").alias("app_highlight"))
    a = apps.select("lpa_app_no").join(per_app, F.col("lpa_app_no") == F.col("application_id"), "left")
    a = a.select(F.lit(True).alias("app"), F.col("application_id").isNotNull().alias("app_commented"), "app_highlight")
    counted = coverage_report(union_fill(c, a), {k: F.col(v) for k, v in (
        ("n_comments", "comment"), ("with_coordinates", "place"), ("with_topic", "topic"), ("with_highlight", "highlight"), ("linkable", "linkable"),
        ("apps_all", "app"), ("apps_commented", "app_commented"), ("apps_highlight", "app_highlight"))})
    return counted.drop("n_rows")


def highlight_legend(comments: DataFrame) -> DataFrame:
    """Counts in the legend of the highlighted-topic map: comments with a place, highlighted ones, those of them
    with an application's place, others."""
    has = comments.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    mark = F.coalesce("is_highlight", F.lit(False))
    linked = mark & F.col("centroid_lat").isNotNull() & F.col("centroid_lon").isNotNull()
    return coverage_report(has, {"highlighted": mark, "highlighted_linked": linked, "others": ~mark})
