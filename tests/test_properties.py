"""Property checks against numpy on random inputs (few examples: each is a Spark job)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from civiclens.operators import histograms as H
from civiclens.operators import quantiles as Q

values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-100, 100, allow_nan=False, width=32)),
                  min_size=1, max_size=60)
SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(a=values, b=values)
def test_quantiles_match_numpy(spark, a, b):
    rows = [("a", x) for x in a] + [("b", x) for x in b]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in Q.exact_quantiles(df, "x", ["g"], [0.0, 0.25, 0.5, 0.9, 1.0],
                                                ["p0", "p25", "p50", "p90", "p100"]).collect()}
    for g, xs in (("a", a), ("b", b)):
        want = np.percentile(np.array(xs, dtype=float), [0, 25, 50, 90, 100])
        have = [got[g][k] for k in ("p0", "p25", "p50", "p90", "p100")]
        assert np.allclose(have, want, rtol=1e-12, atol=1e-9), (g, have, want)


@SETTINGS
@given(xs=values, bins=st.integers(1, 12))
def test_histogram_matches_numpy(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r["n"] for r in H.histogram(df, "x", bins).orderBy("bin").collect()]
    want, _ = np.histogram(np.array(xs, dtype=float), bins=bins)
    assert got == list(want)
