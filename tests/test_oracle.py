"""Layer 1: every registered query against its DuckDB oracle on the fixture views
(sf0.001 always; sf0.01 when CIVICLENS_ORACLE_SF=0.01)."""

import os

import pytest

import __spark_entry__ as E
from civiclens.plans.catalog import QUERIES
from civiclens.plans.oracle import ORACLE
from tests.conftest import SF_SMALL
from tools.check_oracle import compare, duck

SF = os.environ.get("CIVICLENS_ORACLE_SF_DIR", SF_SMALL)
NAMES = sorted(ORACLE)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, name, QUERIES[name], ORACLE[name], SF)
    assert line.startswith("OK"), line


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["council", "supports", "objects", "neutral", "pct_supports", "pct_objects", "pct_neutral"]
