"""Plan properties of the registered queries (scale rules, not values)."""

import uuid

import pytest

from pyspark.sql import functions as F

from civiclens.plans import frames as FR
from civiclens.plans.catalog import QUERIES
from civiclens.sources.fixtures import fixtures
from tests.conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cooccurrence_pairs_without_self_join(spark):
    plan = _plan(QUERIES["topic_cooccurrence"](spark, SF_SMALL))
    assert "Generate explode" in plan            # pairs generated inside each row
    assert plan.count("Join") <= 4               # grid/label joins only, no comment self-join


def test_large_inputs_are_not_dealt_anew(spark, monkeypatch):
    import civiclens.sources.fixtures as module
    plans = []
    monkeypatch.setattr(module, "stored", lambda df, *a: plans.append(_plan(df)) or df)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "1k")                  # many splits, as of a large table
    try:
        fx = module.Fixtures(spark, SF_SMALL)
        fx.comments, fx.topic_text, fx.comments_with_topics
        fx.pld                                   # a small one still becomes a part for each core
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert ["RoundRobinPartitioning" in plan for plan in plans] == [False, False, False, True]
    # the lists are made after the shuffle, and no count of comments is made to find the housing type
    topics, both = plans[1], plans[2]
    lists = topics.index("partial_collect_list")
    assert "REPARTITION_BY_COL" in topics[lists:] and "partial_count" not in both


def test_spatial_join_builds_without_jobs(spark):
    fx = fixtures(spark, SF_SMALL)
    fx.lsoa, fx.comments                        # inputs are written before
    tracker, group = spark.sparkContext.statusTracker(), "spatial-build"
    spark.sparkContext.setJobGroup(group, group)
    try:
        census = FR.census_features(fx.census_age, fx.census_occupation, fx.census_tenure, ["age_50_69", "age_70_plus"],
                                    occ_cols=["occupation_1", "occupation_2_3"], own_cols=["owned_outright", "owned_mortgage"])
        FR.comment_lsoa_codes(fx.comments, fx.lsoa, census)
        assert not tracker.getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_semi_join_keys_are_combined_before_the_shuffle(spark):
    from civiclens.operators.relational import semi_join
    a = spark.range(100).withColumnRenamed("id", "k")
    plan = _plan(semi_join(a, spark.range(1000).select((F.col("id") % 3).alias("k")), "k", "k"))
    assert "LeftSemi" in plan and plan.count("HashAggregate") >= 2


def _jobs(spark, build) -> int:
    """Jobs that building a query starts."""
    tracker, group = spark.sparkContext.statusTracker(), f"build-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        build()
        return len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["box_sentiment_by_topic", "box_distance_by_topic", "describe_distance", "comment_percentiles", "comments_with_centroid_bng",
                                  "regression_bootstrap_band", "kde_sentiment_binned", "lsoa_spatial_join", "topic_frequency"])
def test_building_a_query_starts_no_job(spark, name):
    fx = fixtures(spark, SF_SMALL)
    fx.lsoa, fx.comments_with_topics, fx.topic_names, fx.pld, fx.applications      # inputs are written before
    assert _jobs(spark, lambda: QUERIES[name](spark, SF_SMALL)) == 0


def test_input_of_quantiles_is_evaluated_once(spark):
    """All steps read the shuffle of the distinct values; a hot value is one row of it."""
    from civiclens.operators.quantiles import _pairs, box_stats, exact_quantiles
    df = spark.range(0, 40000, 1, 8).select((F.col("id") % 4).alias("g"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("v"))
    assert _pairs(df, "v", ["g"]).count() == 20002
    q = exact_quantiles(df, "v", ["g"], [0.5])
    got = {x["g"]: (x["n"], x["q50"]) for x in q.collect()}
    assert got[0] == (10000, 0.0) and got[1] == (10000, (19997 + 20001) / 2)
    box = box_stats(df, "v", ["g"])
    box.collect()
    final = _plan(box).split("Initial Plan")[0]
    assert final.count("Range (0, 40000") == 1 and "ReusedExchange" in final


@pytest.mark.parametrize("parts", [1, 7, 16384])
def test_quantiles_of_odd_distributions(spark, monkeypatch, parts):
    import numpy as np
    from civiclens.operators import quantiles as Qn
    monkeypatch.setattr(Qn, "PARTS", parts)
    rng = np.random.default_rng(3)
    groups = {"tail": np.exp(rng.normal(0, 20, 999)), "crowd": np.concatenate([[1e300, -1e300], 5 + rng.random(500) * 1e-9]), "one": np.full(7, 2.5), "few": np.array([1.0, 2.0]),
              "ties": rng.integers(0, 4, 400).astype(float), "tiny": np.array([5e-324, -5e-324, 0.0, -0.0, 1e-300, -1e-300]), "signs": rng.normal(0, 1, 501), "huge": np.array([-1.7e308, 0.0, 1.7e308, 1.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("ties", None), ("ties", float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in Qn.exact_quantiles(df, "v", ["g"], probs, [f"p{i}" for i in range(6)]).collect()}
    assert set(got) == {*groups, None} and got[None]["p3"] == 3.0
    for g, vs in groups.items():
        s = np.sort(vs)
        for i, p in enumerate(probs):
            k = p * (len(s) - 1)
            lo, hi = s[int(np.floor(k))], s[int(np.ceil(k))]
            assert got[g]["n"] == len(vs) and got[g][f"p{i}"] == pytest.approx(lo + (hi - lo) * (k - np.floor(k)), rel=1e-12)
    assert Qn.exact_quantiles(df.where("false"), "v", ["g"], [0.5]).count() == 0
    assert Qn.describe(df.where("false"), "v").first()["count"] == 0


def test_input_of_a_histogram_is_evaluated_once(spark):
    from civiclens.operators.histograms import histogram
    df = spark.range(0, 40000, 1, 4).select((F.col("id") % 3).alias("g"), (F.col("id") % 1000 / 7.0).alias("v"))
    for kw in ({"by": ["g"]}, {"by": ["g"], "shared": True}, {}):
        once, twice = histogram(df, "v", 20, once=True, **kw), histogram(df, "v", 20, **kw)
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    once = histogram(df, "v", 20, by=["g"], once=True)
    once.collect()
    assert _plan(once).split("Initial Plan")[0].count("Range (0, 40000") == 1
