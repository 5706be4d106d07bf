"""The registered queries: each operator bound to the fixture inputs of one
scale-factor directory. `QUERIES[name](spark, sf_dir) -> DataFrame`.

Every query reads the given tables through `Fixtures` and runs over all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civiclens import constants as K
from civiclens.functions.lists import contains, first_ring, parse_double_list, parse_int_list, primary_topic
from civiclens.functions.scalar import area_class, composite_key, label, round2, sign_class, slug, title
from civiclens.operators import aggregates as G
from civiclens.operators import geometry as GM
from civiclens.operators import histograms as H
from civiclens.operators import quantiles as Qn
from civiclens.operators import regression as R
from civiclens.operators import spatial as S
from civiclens.operators.relational import (coverage_report, distinct_values, drop_null, fill_null, filter_eq, filter_in, head_n,
                                            keep_first, left_join, lookup, order_asc, order_desc, rename_drop, select_columns, semi_join,
                                            share_of_total, top_k, union_fill)
from civiclens.plans import frames as FR
from civiclens.sources.sinks import preview
from civiclens.sources.fixtures import FIXTURE_BOROUGH, FIXTURE_INNER, FIXTURE_TOPIC, fixtures

COORDS = FR.COORDS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query | None = None, *, name: str | None = None):
    """Register a query under its function name (or `name`)."""
    def reg(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        return f
    return reg(fn) if fn is not None else reg


def _r(c, d: int = 6):
    return F.round(c if not isinstance(c, str) else F.col(c), d)


# -- G1-G4, P9, G10, G13, S8 -----------------------------------------------------------
@query
def stance_by_council(spark, sf_dir):
    return G.stance_by_council(fixtures(spark, sf_dir).comments)


@query
def overall_summary(spark, sf_dir):
    return G.overall_summary(fixtures(spark, sf_dir).applications)


@query
def council_stats(spark, sf_dir):
    return G.council_stats(fixtures(spark, sf_dir).applications)


@query
def stance_size(spark, sf_dir):
    return G.group_size(fixtures(spark, sf_dir).comments, "stance")


@query
def inner_outer_flag(spark, sf_dir):
    c = fixtures(spark, sf_dir).comments
    return c.select("comment_id", "council", area_class("council", FIXTURE_INNER).alias("london_area"))


@query
def distinct_boroughs(spark, sf_dir):
    return distinct_values(fixtures(spark, sf_dir).applications, "borough")


@query
def comment_percentiles(spark, sf_dir):
    return Qn.percentiles(fixtures(spark, sf_dir).applications, "comment_count", (0.95, 0.99))


@query
def build_applications(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return FR.build_applications(fx.pld.where("src_ord = 0"), fx.comments)


# -- lists and topics ------------------------------------------------------------------
@query
def parse_topic_list(spark, sf_dir):
    t = FR.topic_lists(fixtures(spark, sf_dir).comments_with_topics)
    a = F.col("topic_list")
    return t.select("comment_id",
                    F.when(a.isNotNull(), F.size(a)).cast("long").alias("n_topics"),
                    F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("topic_sum"),
                    F.get(a, 0).alias("first_topic"),
                    F.get(a, F.size(a) - 1).alias("last_topic"))


@query
def parse_probability_list(spark, sf_dir):
    t = fixtures(spark, sf_dir).comments_with_topics.withColumn("p", parse_double_list("probability"))
    a = F.col("p")
    return t.select("comment_id",
                    F.when(a.isNotNull(), F.size(a)).cast("long").alias("n_probs"),
                    _r(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)).alias("prob_sum"),
                    F.when(a.isNotNull(), F.size(F.filter(a, lambda x: x == 0))).cast("long").alias("n_zero"))


@query
def topic_frequency(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return G.topic_frequency(FR.topic_lists(fx.comments_with_topics), fx.topic_names)


@query
def topic_frequency_by_area(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return G.topic_frequency_by_area(FR.topic_lists(fx.comments_with_topics), fx.topic_names, FIXTURE_INNER)


@query
def topic_by_housing_type(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return G.topic_by_housing_type(FR.topic_lists(fx.comments_with_topics), fx.topic_names)


@query
def topic_top20_other(spark, sf_dir):
    return G.top_n_other(fixtures(spark, sf_dir).topic_names)


@query
def nimby_share(spark, sf_dir):
    return G.nimby_share(fixtures(spark, sf_dir).topic_names)


@query
def topic_cooccurrence(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return G.topic_cooccurrence(FR.topic_lists(fx.comments_with_topics), fx.topic_names)


@query(name="primary_topic")
def primary_topic_per_comment(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    ct = fx.topic_text.select("comment_id", parse_int_list("topic_number", missing_as_empty=True).alias("tl"))
    return (fx.comments.select("comment_id").join(ct, "comment_id", "left")
            .select("comment_id", primary_topic("tl").alias("primary_topic")))


@query
def topic_lookup_default(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    p = primary_topic_per_comment(spark, sf_dir)
    return lookup(p, "primary_topic", fx.topic_names, "topic_id",
                  {"color": "topic_color", "topic_group": "topic_label"},
                  {"topic_color": F.lit(K.UNCLASSIFIED_COLOR), "topic_label": F.lit(K.UNCLASSIFIED_LABEL)})


@query
def highlight_flag(spark, sf_dir):
    t = FR.topic_lists(fixtures(spark, sf_dir).comments_with_topics)
    return t.select("comment_id", contains("topic_list", FIXTURE_TOPIC).alias("is_highlight"))


# -- joins -------------------------------------------------------------------------------
@query
def first_row_per_key(spark, sf_dir):
    pld = GM.with_outer_ring(fixtures(spark, sf_dir).pld, COORDS)
    valid = pld.where(F.col("_ring").isNotNull()).select("lpa_app_no", "borough", "src_ord")
    return keep_first(valid, "lpa_app_no", ["src_ord"])


@query
def comments_with_topics(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return (fx.comments.join(fx.topic_text.select("comment_id", "topic_number"), "comment_id", "left")
            .select("comment_id", "application_id", "council", "stance", "topic_number"))


@query
def comments_with_housing(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    p = fx.pld.select(F.col("lpa_app_no").alias("_a"), F.col("borough").alias("_b"), "housing_type",
                      "total_no_proposed_residential_units")
    return (fx.comments.join(p, (F.col("application_id") == F.col("_a")) & (F.col("council") == F.col("_b")), "left")
            .select("comment_id", "application_id", "council", "housing_type",
                    "total_no_proposed_residential_units"))


def _distances(spark, sf_dir, method="planar", with_topics=False):
    fx = fixtures(spark, sf_dir)
    return FR.comment_distances(fx.comments, fx.topic_text, fx.pld, method, with_topics)


@query
def comments_with_centroid(spark, sf_dir):
    d = _distances(spark, sf_dir)
    return d.select("comment_id", _r("app_lat").alias("app_lat"), _r("app_lon").alias("app_lon"))


@query
def comments_with_centroid_bng(spark, sf_dir):
    """Centroids computed in the National Grid (the original analysis' method)."""
    d = _distances(spark, sf_dir, "bng")
    return d.select("comment_id", _r("app_lat").alias("app_lat"), _r("app_lon").alias("app_lon"),
                    _r("distance_km").alias("distance_km"))


@query
def haversine_distance(spark, sf_dir):
    d = _distances(spark, sf_dir)
    return d.select("comment_id", _r("distance_km").alias("distance_km"))


@query
def census_features(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    c = FR.census_features(fx.census_age, fx.census_occupation, fx.census_tenure,
                           age_cols=["age_50_69", "age_70_plus"], occ_cols=["occupation_1", "occupation_2_3"], own_cols=["owned_outright", "owned_mortgage"])
    return c.select("lsoa_code", *[_r(v).alias(v) for v in K.SOCIO_VARS])


@query
def semi_join_apps(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return semi_join(fx.applications, fx.comments, "lpa_app_no", "application_id").select("lpa_app_no", "borough")


# -- geometry ----------------------------------------------------------------------------
@query
def vertex_mean_centroid(spark, sf_dir):
    pld = fixtures(spark, sf_dir).pld.where(F.col(COORDS).isNotNull()).withColumn("_ring", F.get(F.col(COORDS), 0))
    c = GM.with_vertex_mean(pld, "_ring", "lat", "lon")
    return c.select("lpa_app_no", "borough", "src_ord", _r("lat").alias("centroid_lat"),
                    _r("lon").alias("centroid_lon"))


@query
def area_centroid(spark, sf_dir):
    pld = GM.with_outer_ring(fixtures(spark, sf_dir).pld, COORDS).where(F.col("_ring").isNotNull())
    # Valid polygons; a degenerate (zero-area) ring keeps its row with NULL centroid.
    c = GM.with_area_centroid(pld, "_ring", "cx", "cy", "area")
    return c.select("lpa_app_no", "borough", "src_ord", _r("cx").alias("centroid_x"),
                    _r("cy").alias("centroid_y"), _r("area").alias("area"))


def _lsoa_sides(spark, sf_dir):
    lsoa = fixtures(spark, sf_dir).lsoa
    ext = S.extent(lsoa, "rings")
    cen = S.area_centroids(lsoa, "rings").select("LSOA21CD", "centroid_x", "centroid_y")
    return S.nearest_edge(cen, ext), ext


@query
def extent_padded(spark, sf_dir):
    lsoa = fixtures(spark, sf_dir).lsoa
    return S.padded_extent(S.extent(lsoa, "rings"), margin_fraction=K.EXTENT_MARGIN_FRACTION)


@query
def nearest_edge(spark, sf_dir):
    sides, _ = _lsoa_sides(spark, sf_dir)
    return sides.select(F.col("LSOA21CD").alias("lsoa_code"), _r("centroid_x").alias("centroid_x"),
                        _r("centroid_y").alias("centroid_y"), "side")


@query
def even_spacing_rank(spark, sf_dir):
    sides, ext = _lsoa_sides(spark, sf_dir)
    out = S.even_spacing(sides, ext, K.EXTENT_MARGIN_FRACTION, "LSOA21CD")
    return out.select(F.col("LSOA21CD").alias("lsoa_code"), "side", "rank", "n_side", "label_x", "label_y")


# -- borough report frames -------------------------------------------------------------
def _borough(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return FR.borough_frames(fx.comments, fx.pld, fx.topic_text, fx.topic_names, FIXTURE_BOROUGH, FIXTURE_TOPIC)


@query
def comment_application_edges(spark, sf_dir):
    b = _borough(spark, sf_dir)
    e = S.comment_application_edges(b["comments"])
    return e.select("comment_id", _r("lat").alias("lat"), _r("lon").alias("lon"),
                    _r("centroid_lat").alias("centroid_lat"), _r("centroid_lon").alias("centroid_lon"))


@query
def borough_topic_legend(spark, sf_dir):
    b = _borough(spark, sf_dir)
    pts = b["comments"].where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return G.borough_topic_legend(pts)


@query
def borough_highlight_apps(spark, sf_dir):
    b = _borough(spark, sf_dir)
    return b["apps_highlight"].select("lpa_app_no", _r("centroid_lat").alias("centroid_lat"),
                                      _r("centroid_lon").alias("centroid_lon"))


@query(name="coverage_report")
def coverage_report_borough(spark, sf_dir):
    b = _borough(spark, sf_dir)
    return FR.borough_coverage(b["comments"], b["apps"])


@query
def borough_highlight_edges(spark, sf_dir):
    """Edges of the highlighted-topic map."""
    e = S.comment_application_edges(_borough(spark, sf_dir)["comments"].where("is_highlight"))
    return e.select("comment_id", _r("lat").alias("lat"), _r("lon").alias("lon"),
                    _r("centroid_lat").alias("centroid_lat"), _r("centroid_lon").alias("centroid_lon"))


@query
def borough_highlight_legend(spark, sf_dir):
    return FR.highlight_legend(_borough(spark, sf_dir)["comments"])


@query
def map_extent(spark, sf_dir):
    """The extent of a map's boundary with the fixed margin in degrees."""
    return S.padded_extent(S.extent(fixtures(spark, sf_dir).lsoa, "rings"), pad=K.MAP_PAD_DEG)


# -- distributions -----------------------------------------------------------------------
@query
def describe_distance(spark, sf_dir):
    return Qn.describe(_distances(spark, sf_dir), "distance_km")


@query
def hist_comments(spark, sf_dir):
    return H.histogram(fixtures(spark, sf_dir).applications, "comment_count", 50)


@query
def hist_distance_fixed(spark, sf_dir):
    return H.histogram_fixed(_distances(spark, sf_dir), "distance_km", 0.1, 20.0)


@query
def hist_sentiment_by_stance(spark, sf_dir):
    return H.histogram(fixtures(spark, sf_dir).comments, "sentiment_score", 40, by=["stance"], shared=True)


@query
def hist_sentiment_by_sign(spark, sf_dir):
    c = fixtures(spark, sf_dir).comments.withColumn("sign", sign_class("sentiment_score"))
    return H.histogram(c, "sentiment_score", 20, by=["council", "sign"])


@query
def hist_distance_by_stance(spark, sf_dir):
    d = _distances(spark, sf_dir).where(F.col("stance").isin(K.STANCES))
    return H.histogram(d, "distance_km", 50, by=["stance"], once=True)


@query
def kde_sentiment(spark, sf_dir):
    return H.kde_1d(fixtures(spark, sf_dir).comments, "sentiment_score", "stance", 200, bins_for_scale=40)


@query
def kde_sentiment_binned(spark, sf_dir):
    b = H.kde_binned(fixtures(spark, sf_dir).comments, "sentiment_score", "stance", 200, bins=1024, bins_for_scale=40)
    return b.select("stance", "grid_index", "x", "density", "scaled", _r("error", 9).alias("error"))


def _top_named(spark, sf_dir, n):
    fx = fixtures(spark, sf_dir)
    freq = G.topic_frequency(FR.topic_lists(fx.comments_with_topics), fx.topic_names)
    return freq.where(F.col("rank") < n).select("topic_id", "topic_group")


@query
def box_sentiment_by_topic(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    t = FR.topic_lists(fx.comments_with_topics)
    top = _top_named(spark, sf_dir, K.TOP_TOPICS_BAR)
    m = t.select("sentiment_score", F.explode("topic_list").alias("topic_id"))
    m = m.join(F.broadcast(top), "topic_id")  # at most 20 rows
    b = Qn.box_stats(m, "sentiment_score", ["topic_id"])
    return b.join(fx.topic_names.select("topic_id", "topic_group"), "topic_id")


@query
def box_distance_by_topic(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    d = _distances(spark, sf_dir, with_topics=True)
    top = G.top_topics(d, K.TOP_TOPICS_DISTANCE).select(F.col("topic").alias("topic_id"))
    # Containment: a topic repeated in one list counts once.
    m = d.select("distance_km", F.explode(F.array_distinct("topic_list")).alias("topic_id"))
    m = m.join(F.broadcast(top), "topic_id")  # at most 15 rows
    b = Qn.box_stats(m, "distance_km", ["topic_id"])
    lab = lookup(b, "topic_id", fx.topic_names, "topic_id", {"topic_group": "label"},
                 {"label": F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))})
    return lab


@query
def box_distance_by_housing(spark, sf_dir):
    d = _distances(spark, sf_dir).where(F.col("housing_type").isNotNull())
    return Qn.box_stats(d, "distance_km", ["housing_type"])


@query
def box_comments_by_housing(spark, sf_dir):
    a = fixtures(spark, sf_dir).applications.where(F.col("housing_type").isNotNull())
    return Qn.box_stats(a, "comment_count", ["housing_type"])


@query
def box_sentiment_by_housing(spark, sf_dir):
    """Sentiment by housing type (announced in the original, computed here)."""
    t = fixtures(spark, sf_dir).comments_with_topics.where(F.col("housing_type").isNotNull())
    return Qn.box_stats(t, "sentiment_score", ["housing_type"])


@query
def comment_points_bng(spark, sf_dir):
    """Commenter points on the National Grid (Helmert + transverse Mercator),
    to the millimetre; also checked by the published worked example."""
    c = fixtures(spark, sf_dir).comments.select("comment_id", "lat", "lon")
    p = GM.with_bng(c, "lat", "lon", "bng_e", "bng_n")
    return p.select("comment_id", _r("bng_e", 3).alias("bng_e"), _r("bng_n", 3).alias("bng_n"))


@query
def regression_by_housing(spark, sf_dir):
    return R.regression_by_housing(fixtures(spark, sf_dir).applications)


@query
def regression_bootstrap_band(spark, sf_dir):
    a = fixtures(spark, sf_dir).applications.where(
        F.col("housing_type").isin([h for h in K.HOUSING_ORDER if h != "Other"]))
    return R.regression_band(a, "total_no_proposed_residential_units", "comment_count", "housing_type")


# -- demographics (Q5) ---------------------------------------------------------------------
def _census(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return FR.census_features(fx.census_age, fx.census_occupation, fx.census_tenure,
                              age_cols=["age_50_69", "age_70_plus"], occ_cols=["occupation_1", "occupation_2_3"], own_cols=["owned_outright", "owned_mortgage"])


def _comments_lsoa(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return FR.comments_with_lsoa(fx.comments, fx.lsoa, _census(spark, sf_dir))


@query
def lsoa_spatial_join(spark, sf_dir):
    fx = fixtures(spark, sf_dir)
    return FR.comment_lsoa_codes(fx.comments, fx.lsoa, _census(spark, sf_dir)).select("comment_id", "lsoa_code")


@query
def lsoa_profile(spark, sf_dir):
    return G.lsoa_profile(_comments_lsoa(spark, sf_dir))


def _lsoa_long(spark, sf_dir):
    """(variable, x, num_comments) per LSOA profile row, for the three shares."""
    g = G.lsoa_profile(_comments_lsoa(spark, sf_dir), digits=None)
    stack = F.expr("stack(3, 'percent_age_50_plus', percent_age_50_plus, "
                   "'percent_occupation_1_2_3', percent_occupation_1_2_3, "
                   "'percent_owned_total', percent_owned_total) AS (variable, x)")
    return g.select("lsoa_code", "num_comments", stack)


def _lsoa_responses(spark, sf_dir):
    """(variable, response, x, y): both responses of every share in one long frame,
    so each statistic is one aggregate over one evaluation of the LSOA pipeline."""
    lg = _lsoa_long(spark, sf_dir)
    resp = F.expr("stack(2, 'raw', CAST(num_comments AS DOUBLE), 'log1p', log1p(num_comments)) AS (response, y)")
    return lg.select("variable", "x", resp)


@query
def lsoa_regression(spark, sf_dir):
    return R.ols(_lsoa_responses(spark, sf_dir), "x", "y", ["variable", "response"])


def _correlation(spark, sf_dir, with_p):
    return R.pearson(_lsoa_responses(spark, sf_dir), "x", "y", ["variable", "response"], with_p)


@query
def lsoa_correlation(spark, sf_dir):
    return _correlation(spark, sf_dir, False)


@query
def lsoa_correlation_p(spark, sf_dir):
    return _correlation(spark, sf_dir, True)


def _welch(spark, sf_dir, with_p):
    census = _census(spark, sf_dir)
    with_comments = _comments_lsoa(spark, sf_dir).where(F.col("lsoa_code").isNotNull())
    b = semi_join(census, with_comments, "lsoa_code", "lsoa_code")
    stack = F.expr("stack(3, 'percent_age_50_plus', percent_age_50_plus, "
                   "'percent_occupation_1_2_3', percent_occupation_1_2_3, "
                   "'percent_owned_total', percent_owned_total) AS (variable, value)")
    return R.welch_t(census.select(stack), b.select(stack), "value", by=["variable"], with_p=with_p)


@query
def welch_test(spark, sf_dir):
    return _welch(spark, sf_dir, False)


@query
def welch_test_p(spark, sf_dir):
    return _welch(spark, sf_dir, True)


@query
def hist_census_feature(spark, sf_dir):
    c = _comments_lsoa(spark, sf_dir)
    stack = F.expr("stack(3, 'percent_age_50_plus', percent_age_50_plus, "
                   "'percent_occupation_1_2_3', percent_occupation_1_2_3, "
                   "'percent_owned_total', percent_owned_total) AS (variable, value)")
    return H.histogram(c.select(stack), "value", 30, by=["variable"], once=True)


# -- tables behind the figures: P1-P7, P12, P15, P17, W2, O1-O4, U1, A6, K3 ------------------
@query
def housing_type_shares(spark, sf_dir):
    """Applications and units per listed housing type, with their share of all listed applications."""
    a = rename_drop(fixtures(spark, sf_dir).applications, {"total_no_proposed_residential_units": "units"}, ["borough"])
    a = fill_null(filter_in(drop_null(a, ["housing_type"]), "housing_type", K.HOUSING_ORDER), {"units": 0})
    g = a.groupBy("housing_type").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.avg("comment_count").alias("mean_comments"))
    g = share_of_total(g, "n", "pct", digits=6).withColumn("mean_comments", round2("mean_comments"))
    return order_desc(select_columns(g, ["housing_type", "n", "units", "mean_comments", "pct"]), "n", "housing_type")


@query
def borough_top_applications(spark, sf_dir):
    """The ten most commented applications of the fixture's borough, labelled (a top-k report)."""
    a = filter_eq(fixtures(spark, sf_dir).applications, "borough", FIXTURE_BOROUGH)
    top = head_n(a, 10, [F.desc("comment_count"), F.asc("lpa_app_no")])
    return top.select("lpa_app_no", slug("borough").alias("file_name"), title("housing_type").alias("heading"),
                      label("%s: %d comments", "lpa_app_no", "comment_count").alias("caption"))


@query
def busiest_councils(spark, sf_dir):
    """The five councils with most comments, in the order of the axis (a top-k report)."""
    return order_asc(top_k(fixtures(spark, sf_dir).comments, "council", 5), "n", "council")


@query
def map_points(spark, sf_dir):
    """Comment points and application points (first vertex of the outer ring) in one table."""
    fx = fixtures(spark, sf_dir)
    c = drop_null(fx.comments, ["lat", "lon"]).select("comment_id", "lat", "lon")
    first = F.get(first_ring(COORDS), 0)
    a = drop_null(fx.pld.select("lpa_app_no", "borough", F.get(first, 1).alias("lat"), F.get(first, 0).alias("lon")), ["lat", "lon"])
    return union_fill(c, a)


@query
def comments_with_application_key(spark, sf_dir):
    """Comments with the housing type, joined on one composite text key; a missing council matches nothing."""
    fx = fixtures(spark, sf_dir)
    p = fx.pld.select(composite_key("lpa_app_no", "borough").alias("app_key"), "housing_type")
    c = fx.comments.select("comment_id", composite_key("application_id", "council").alias("app_key"))
    return left_join(c, p, "app_key")


@query
def comment_preview(spark, sf_dir):
    """First five comments by id (the preview of the notebooks)."""
    return preview(fixtures(spark, sf_dir).comments.orderBy("comment_id").select("comment_id", "application_id", "stance"), 5)
