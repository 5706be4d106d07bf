"""The six analyses (Q1-Q6) as functions from the input tables to the named
tables behind each figure, plus `write_report` (K1).

Inputs have the shapes of the original files: `comments`, `comments_with_topics`
(list columns as text), `topic_names` (normalised by `sources.readers`), `pld`
(with the nested coordinate column), `applications`, LSOA boundaries
(`LSOA21CD`, `rings`) and the three census sheets. A frame that several analyses
reuse is materialised once in the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiclens import constants as K
from civiclens.functions.lists import rejected
from civiclens.functions.scalar import area_class, sign_class, slug
from civiclens.operators import aggregates as G
from civiclens.operators import histograms as H
from civiclens.operators import quantiles as Qn
from civiclens.operators import regression as R
from civiclens.operators import spatial as S
from civiclens.operators.relational import coverage_report, distinct_values, filter_in, lookup, semi_join
from civiclens.plans import frames as FR
from civiclens.tables import counted, stored
from civiclens.sources.sinks import publish


@dataclass
class Inputs:
    comments: DataFrame
    comments_with_topics: DataFrame
    topic_names: DataFrame
    pld: DataFrame
    applications: DataFrame
    lsoa: DataFrame | None = None
    census_age: DataFrame | None = None
    census_occupation: DataFrame | None = None
    census_tenure: DataFrame | None = None
    lad: DataFrame | None = None           # LAD24NM, parts (read_geojson; boundary maps of Q1 and Q6)
    lpa: DataFrame | None = None           # new_lpa_names, parts (read_geojson; extra authorities of Q1)
    inner: Sequence[str] = field(default_factory=lambda: list(K.INNER_LONDON_BOROUGHS))
    census_cols: dict = field(default_factory=dict)   # overrides for FR.census_features

    @classmethod
    def from_fixtures(cls, fx) -> "Inputs":
        from civiclens.sources.fixtures import FIXTURE_INNER
        return cls(fx.comments, fx.comments_with_topics, fx.topic_names, fx.pld, fx.applications, fx.lsoa,
                   fx.census_age, fx.census_occupation, fx.census_tenure, None, None, FIXTURE_INNER,
                   {"age_cols": ["age_50_69", "age_70_plus"], "occ_cols": ["occupation_1", "occupation_2_3"], "own_cols": ["owned_outright", "owned_mortgage"]})


def descriptive_report(i: Inputs) -> dict[str, DataFrame]:
    """Q1: summary tables, comment-count distribution, units vs comments fits."""
    apps = i.applications
    out = {
        "overall_summary": G.overall_summary(apps),
        "council_stats": G.council_stats(apps),
        "comment_count_percentiles": Qn.percentiles(apps, "comment_count", (0.95, 0.99)),
        "comment_count_histogram": H.histogram(apps, "comment_count", 50),
        "units_vs_comments_fit": R.regression_by_housing(apps),
        "units_vs_comments_band": R.regression_band(
            apps.where(F.col("housing_type").isin([h for h in K.HOUSING_ORDER if h != "Other"])),
            "total_no_proposed_residential_units", "comment_count", "housing_type"),
        "comments_by_housing_box": Qn.box_stats(apps.where(F.col("housing_type").isNotNull()),
                                                "comment_count", ["housing_type"]),
        "boroughs": distinct_values(apps, "borough"),
    }
    if i.lad is not None:
        # LAD boundaries as read by `read_geojson`: LAD24NM, parts (parts -> rings -> points).
        lad = i.lad.withColumn("_rings", F.flatten("parts"))
        areas = lad.withColumn("london_area", area_class("LAD24NM", i.inner))
        highlighted = areas.join(apps.select(F.col("borough").alias("LAD24NM")).distinct(), "LAD24NM", "left_semi")
        ext = S.extent(lad, "_rings")
        sides = S.nearest_edge(S.area_centroids(highlighted, "parts", parts=True), ext)
        out["lad_map"] = areas.select("LAD24NM", "london_area")
        out["lad_labels"] = (S.even_spacing(sides, ext, K.EXTENT_MARGIN_FRACTION, "LAD24NM")
                             .select("LAD24NM", "london_area", "centroid_x", "centroid_y", "side", "rank",
                                     "n_side", "label_x", "label_y"))
        out["lad_extent"] = S.padded_extent(ext, margin_fraction=K.EXTENT_MARGIN_FRACTION)
    if i.lpa is not None:
        extra = filter_in(i.lpa, "new_lpa_names", K.EXTRA_LPAS)
        out["lpa_labels"] = S.area_centroids(extra, "parts", parts=True).select("new_lpa_names", "centroid_x", "centroid_y")
    return out


def topic_report(i: Inputs) -> dict[str, DataFrame]:
    """Q2: topic frequency (all, inner/outer, by housing type), pies, sentiment by
    topic, co-occurrence. The parsed lists are materialised once for all of them."""
    t, rejects = counted(FR.topic_lists(i.comments_with_topics), "topics", rejected_topics=rejected("topic_number", "topic_list"))
    names = i.topic_names
    freq = G.topic_frequency(t, names)
    top20 = freq.where(F.col("rank") < K.TOP_TOPICS_BAR).select("topic_id")
    m = t.select("sentiment_score", F.explode("topic_list").alias("topic_id")).join(F.broadcast(top20), "topic_id")
    return {
        "topic_frequency": freq,
        "topic_frequency_pie": G.top_n_other(names),
        "topic_frequency_pie_nimby": G.nimby_share(names),
        "topic_inner_outer_london": G.topic_frequency_by_area(t, names, i.inner),
        "topic_by_housing_type": G.topic_by_housing_type(t, names),
        "sentiment_by_topic": Qn.box_stats(m, "sentiment_score", ["topic_id"]).join(
            names.select("topic_id", "topic_group"), "topic_id"),
        "topic_cooccurrence": G.topic_cooccurrence(t, names),
        "rejects": rejects,
    }


def sentiment_report(i: Inputs) -> dict[str, DataFrame]:
    """Q3: stance counts, sentiment histograms and KDE, stance shares per council."""
    c = i.comments
    signed = c.withColumn("sign", sign_class("sentiment_score"))
    cwt = i.comments_with_topics.where(F.col("housing_type").isNotNull())
    return {
        "stance_size": G.group_size(c, "stance"),
        "sentiment_distribution": H.histogram(c, "sentiment_score", 40, by=["stance"], shared=True),
        "sentiment_kde": H.kde_1d(c, "sentiment_score", "stance", 200, bins_for_scale=40),
        "stance_by_council": G.stance_by_council(c),
        "sentiment_by_council": H.histogram(signed, "sentiment_score", 20, by=["council", "sign"]),
        "sentiment_by_housing_box": Qn.box_stats(cwt, "sentiment_score", ["housing_type"]),
    }


def distance_report(i: Inputs, centroid_method: str = "bng") -> dict[str, DataFrame]:
    """Q4: commenter-application distances and their distributions. The distance
    frame is materialised once and every distribution reads it."""
    d, rejects = counted(FR.comment_distances(
        i.comments, i.comments_with_topics.select("comment_id", "topic_number", "probability"),
        i.pld, centroid_method), "distances", rejected_topics=rejected("topic_number", "topic_list"), rejected_probabilities=rejected("probability", "prob_list"))
    top = G.top_topics(d, K.TOP_TOPICS_DISTANCE).select(F.col("topic").alias("topic_id"))
    m = d.select("distance_km", F.explode(F.array_distinct("topic_list")).alias("topic_id")) \
         .join(F.broadcast(top), "topic_id")
    by_topic = lookup(Qn.box_stats(m, "distance_km", ["topic_id"]), "topic_id", i.topic_names, "topic_id",
                      {"topic_group": "label"},
                      {"label": F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))})
    return {
        "comment_distances": d.select("comment_id", "application_id", "council", "stance", "housing_type",
                                      "app_lat", "app_lon", "distance_km"),
        "distance_summary": Qn.describe(d, "distance_km"),
        "distance_histogram": H.histogram_fixed(d, "distance_km", 0.1, 20.0),
        "distance_by_stance": H.histogram(d.where(F.col("stance").isin(K.STANCES)), "distance_km", 50, by=["stance"]),
        "distance_by_topic": by_topic,
        "distance_by_housing_type": Qn.box_stats(d.where(F.col("housing_type").isNotNull()), "distance_km",
                                                 ["housing_type"]),
        "rejects": rejects,
    }


def demographic_report(i: Inputs) -> dict[str, DataFrame]:
    """Q5: census shares, point-in-LSOA join, Welch tests, per-LSOA profile, fits,
    correlations and feature histograms."""
    census = FR.census_features(i.census_age, i.census_occupation, i.census_tenure, **i.census_cols)
    c = stored(FR.comments_with_lsoa(i.comments, i.lsoa, census))
    prof = G.lsoa_profile(c, digits=None)
    stack = ("stack(3, 'percent_age_50_plus', percent_age_50_plus, 'percent_occupation_1_2_3', "
             "percent_occupation_1_2_3, 'percent_owned_total', percent_owned_total) AS (variable, {v})")
    lg = prof.select("lsoa_code", "num_comments", F.expr(stack.format(v="x")))
    y_raw, y_log = F.col("num_comments").cast("double"), F.log1p("num_comments")
    fits = R.ols(lg, "x", y_raw, ["variable"]).withColumn("response", F.lit("raw")).unionByName(
        R.ols(lg, "x", y_log, ["variable"]).withColumn("response", F.lit("log1p")))
    corr = R.pearson(lg, "x", y_raw, ["variable"], True).withColumn("response", F.lit("raw")).unionByName(
        R.pearson(lg, "x", y_log, ["variable"], True).withColumn("response", F.lit("log1p")))
    with_c = semi_join(census, c.where(F.col("lsoa_code").isNotNull()), "lsoa_code", "lsoa_code")
    welch = R.welch_t(census.select(F.expr(stack.format(v="value"))), with_c.select(F.expr(stack.format(v="value"))),
                      "value", by=["variable"], with_p=True)
    return {
        "census_features": census,
        "comment_lsoa": c.select("comment_id", "lsoa_code"),
        "welch_tests": welch,
        "lsoa_profile": G.lsoa_profile(c),
        "demographic_fits": fits,
        "demographic_correlations": corr,
        "demographic_distributions": H.histogram(c.select(F.expr(stack.format(v="value"))), "value", 30,
                                                 by=["variable"]),
        "coverage": coverage_report(c, {"with_lsoa": F.col("lsoa_code").isNotNull()}),
    }


def borough_report(i: Inputs, borough: str, topic_id: int, highlight: str | None = None) -> dict[str, DataFrame]:
    """Q6: the four borough maps' tables and legend counts. highlight: the colour of the highlighted topic (its own
    without one). The maps' extent needs the boundaries `lad`."""
    b = FR.borough_frames(i.comments, i.pld, i.comments_with_topics.select("comment_id", "topic_number"),
                          i.topic_names, borough, topic_id)
    bc, rejects = counted(b["comments"], "borough", rejected_topics=F.coalesce("topic_rejected", F.lit(False)))
    has = bc.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    # One row (a global aggregate): the topic's label and colour, or the fallbacks.
    hit = F.col("topic_id") == topic_id
    color = F.coalesce(F.max(F.when(hit, F.col("color"))), F.lit(K.HIGHLIGHT_FALLBACK_COLOR)) if highlight is None else F.lit(highlight)
    label = i.topic_names.agg(
        F.coalesce(F.max(F.when(hit, F.col("topic_group"))), F.lit(f"topic {topic_id}")).alias("topic_group"), color.alias("color"))
    key = slug(F.lit(borough))
    out = {
        "comment_application_graph": S.comment_application_edges(bc),
        "comment_topics_map": has.select("comment_id", "lat", "lon", "primary_topic", "topic_label", "topic_color"),
        "comment_topics_legend": G.borough_topic_legend(has),
        "highlight_map": has.select("comment_id", "lat", "lon", "is_highlight", "centroid_lat", "centroid_lon"),
        "highlight_edges": S.comment_application_edges(bc.where("is_highlight")).select("comment_id", "lat", "lon", "centroid_lat", "centroid_lon"),
        "highlight_legend": FR.highlight_legend(bc),
        "applications_map": b["apps_highlight"],
        "applications_commented": b["apps_commented"],
        "highlight_topic": label.select(F.lit(topic_id).alias("topic_id"), key.alias("slug"), "color", "topic_group"),
        "coverage": FR.borough_coverage(bc, b["apps"]),
        "rejects": rejects,
    }
    if i.lad is not None:
        own = i.lad.where(F.col("LAD24NM") == borough).withColumn("_rings", F.flatten("parts"))
        out["map_extent"] = S.padded_extent(S.extent(own, "_rings"), pad=K.MAP_PAD_DEG)
    return out


def write_report(frames: dict[str, DataFrame], results_dir: str, prefix: str = "") -> dict[str, str]:
    """K1: publish the tables of a report under results_dir (Parquet), all at once (sources.sinks)."""
    return publish(frames, results_dir, prefix or "report", prefix)
