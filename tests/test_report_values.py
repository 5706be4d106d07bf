"""The tables of the six reports hold the values of the DuckDB oracles; rejects are counted; publishing is atomic."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from civiclens.plans import reports as Rp
from civiclens.plans.oracle import ORACLE
from civiclens.sources import sinks
from civiclens.sources.fixtures import BASE_TABLES, FIXTURE_BOROUGH, FIXTURE_TOPIC, fixtures
from tests.conftest import SF_SMALL

#: report, its tables and the oracle of each
REPORTS = {
    "descriptive": (Rp.descriptive_report, {
        "overall_summary": "overall_summary", "council_stats": "council_stats", "comment_count_percentiles": "comment_percentiles",
        "comment_count_histogram": "hist_comments", "units_vs_comments_fit": "regression_by_housing", "units_vs_comments_band": "regression_bootstrap_band",
        "comments_by_housing_box": "box_comments_by_housing", "boroughs": "distinct_boroughs"}),
    "topic": (Rp.topic_report, {
        "topic_frequency": "topic_frequency", "topic_frequency_pie": "topic_top20_other", "topic_frequency_pie_nimby": "nimby_share",
        "topic_inner_outer_london": "topic_frequency_by_area", "topic_by_housing_type": "topic_by_housing_type", "sentiment_by_topic": "box_sentiment_by_topic",
        "topic_cooccurrence": "topic_cooccurrence"}),
    "sentiment": (Rp.sentiment_report, {
        "stance_size": "stance_size", "sentiment_distribution": "hist_sentiment_by_stance", "sentiment_kde": "kde_sentiment", "stance_by_council": "stance_by_council",
        "sentiment_by_council": "hist_sentiment_by_sign", "sentiment_by_housing_box": "box_sentiment_by_housing"}),
    "distance": (lambda i: Rp.distance_report(i, "planar"), {
        "comment_distances": "haversine_distance", "distance_summary": "describe_distance", "distance_histogram": "hist_distance_fixed",
        "distance_by_stance": "hist_distance_by_stance", "distance_by_topic": "box_distance_by_topic", "distance_by_housing_type": "box_distance_by_housing"}),
    "demographic": (Rp.demographic_report, {
        "census_features": "census_features", "comment_lsoa": "lsoa_spatial_join", "welch_tests": "welch_test_p", "lsoa_profile": "lsoa_profile",
        "demographic_fits": "lsoa_regression", "demographic_correlations": "lsoa_correlation_p", "demographic_distributions": "hist_census_feature"}),
    "borough": (lambda i: Rp.borough_report(i, FIXTURE_BOROUGH, FIXTURE_TOPIC), {
        "comment_application_graph": "comment_application_edges", "comment_topics_legend": "borough_topic_legend", "applications_map": "borough_highlight_apps",
        "highlight_edges": "borough_highlight_edges", "highlight_legend": "borough_highlight_legend", "coverage": "coverage_report"}),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def ordered(rows):
    """Rows in the order of their exact values; numbers as floats."""
    rows = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "as_tuple") else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: [(v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in r])


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_report_tables_hold_the_oracles_values(spark, duck, name):
    build, tables = REPORTS[name]
    frames = build(Rp.Inputs.from_fixtures(fixtures(spark, SF_SMALL)))
    for table, oracle in tables.items():
        want = duck.sql(ORACLE[oracle])
        columns = sorted(want.columns, key=lambda c: (dict(zip(want.columns, map(str, want.types), strict=True))[c] == "DOUBLE", c))
        got = ordered(frames[table].select(*columns).collect())
        wanted = ordered(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
        assert len(got) == len(wanted) > 0, table
        for g, w in zip(got, wanted, strict=True):
            assert [v for v in g if not isinstance(v, float)] == [v for v in w if not isinstance(v, float)], table
            assert [v for v in g if isinstance(v, float)] == pytest.approx([v for v in w if isinstance(v, float)], abs=2e-6, rel=1e-9), table


def test_every_report_with_lists_counts_rejected_literals(spark):
    i = Rp.Inputs.from_fixtures(fixtures(spark, SF_SMALL))
    bad = F.col("comment_id") % 10 == 0
    council = i.comments.select("comment_id", F.col("council").alias("_c"))
    i.comments_with_topics = i.comments_with_topics.withColumns({
        "topic_number": F.when(bad, "[1, oops").otherwise(F.col("topic_number")), "probability": F.when(F.col("comment_id") % 5 == 0, "[x]").otherwise(F.col("probability"))})
    texts = i.comments_with_topics.join(council, "comment_id")
    want = texts.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.count_if(F.col("probability") == "[x]").alias("p"),
                     F.count_if(bad & (F.col("_c") == FIXTURE_BOROUGH)).alias("own")).first()
    assert Rp.topic_report(i)["rejects"].first().asDict() == {"n_rows": want["n"], "rejected_topics": want["bad"]}
    distance = Rp.distance_report(i, "planar")["rejects"].first()
    assert distance["rejected_topics"] >= want["bad"] > 0 and distance["rejected_probabilities"] >= want["p"] > 0  # pld duplicates fan out
    assert Rp.borough_report(i, FIXTURE_BOROUGH, FIXTURE_TOPIC)["rejects"].first()["rejected_topics"] == want["own"] > 0


def test_borough_report_extent_and_colour(spark):
    i = Rp.Inputs.from_fixtures(fixtures(spark, SF_SMALL))
    ring = [[0.0, 51.0], [1.0, 51.0], [1.0, 52.0], [0.0, 52.0]]
    i.lad = spark.createDataFrame([(FIXTURE_BOROUGH, [[ring]]), ("other", [[[[9.0, 9.0]] * 3]])], "LAD24NM string, parts array<array<array<array<double>>>>")
    i.lpa = i.lad.select(F.when(F.col("LAD24NM") == "other", "OPDC").otherwise("Camden").alias("new_lpa_names"), "parts")
    out = Rp.borough_report(i, FIXTURE_BOROUGH, FIXTURE_TOPIC, highlight="#123456")
    e = out["map_extent"].first()
    assert (e["xlim_lo"], e["xlim_hi"], e["ylim_lo"], e["ylim_hi"]) == (-0.04, 1.04, 50.96, 52.04)
    assert out["highlight_topic"].first()["color"] == "#123456"
    assert [tuple(r) for r in Rp.descriptive_report(i)["lpa_labels"].collect()] == [("OPDC", 9.0, 9.0)]


def test_a_failed_run_leaves_the_old_tables(spark, tmp_path):
    place = str(tmp_path / "results")
    a, b = spark.range(3), spark.range(4)
    first = Rp.write_report({"a": a, "b": b}, place, prefix="x_")
    assert sorted(os.listdir(place)) == ["_published", "x_a", "x_b"]
    fails = spark.range(5).select(F.raise_error(F.lit("boom")).cast("long").alias("id"))
    with pytest.raises(Exception, match="boom"):
        Rp.write_report({"a": spark.range(9), "b": fails}, place, prefix="x_")
    assert sinks.published(spark, place) == {"x_a": first["a"], "x_b": first["b"]}
    assert (sinks.read_result(spark, place, "x_a").count(), sinks.read_result(spark, place, "x_b").count()) == (3, 4)
    second = Rp.write_report({"a": spark.range(7)}, place, prefix="x_")
    assert sinks.published(spark, place) == {"x_a": second["a"]} and sinks.read_result(spark, place, "x_a").count() == 7
    sinks.write_result(b, place, "single")
    assert sinks.read_result(spark, place, "single").count() == 4 and len(sinks.prune(spark, place)) == 2
    assert sinks.read_result(spark, place, "x_a").count() == 7
    assert sinks.published(spark, str(tmp_path / "nothing")) == {}


def test_counts(spark):
    assert sinks.row_count(spark.range(5)).first()["n_rows"] == 5
