"""Reports write all their tables; streaming ingestion is exactly-once."""

import os

from pyspark.sql import functions as F

from civiclens.plans import reports as Rp
from civiclens.sources.fixtures import FIXTURE_BOROUGH, FIXTURE_TOPIC, fixtures
from civiclens.sources.readers import read_comments
from civiclens.streaming.ingest import ingest_csv
from tests.conftest import SF_SMALL


def _inputs(spark):
    return Rp.Inputs.from_fixtures(fixtures(spark, SF_SMALL))


def test_reports_write_all_tables(spark, tmp_path):
    i = _inputs(spark)
    for name, frames in [("q1", Rp.descriptive_report(i)), ("q2", Rp.topic_report(i)), ("q3", Rp.sentiment_report(i)),
                         ("q4", Rp.distance_report(i)), ("q5", Rp.demographic_report(i)),
                         ("q6", Rp.borough_report(i, FIXTURE_BOROUGH, FIXTURE_TOPIC))]:
        paths = Rp.write_report(frames, str(tmp_path), prefix=f"{name}_")
        for p in paths.values():
            assert os.path.isdir(p)
            spark.read.parquet(p).count()


def test_topic_cooccurrence_symmetric_zero_diagonal(spark):
    co = Rp.topic_report(_inputs(spark))["topic_cooccurrence"].collect()
    cell = {(r["topic_a"], r["topic_b"]): r["n"] for r in co}
    assert all(cell[(a, a)] == 0 for a, _ in cell)
    assert all(cell[(a, b)] == cell[(b, a)] for a, b in cell)


def test_spatial_join_keeps_every_comment(spark):
    i = _inputs(spark)
    c = Rp.demographic_report(i)["comment_lsoa"]
    assert c.count() == i.comments.count()


def test_streaming_ingest_exactly_once(spark, tmp_path):
    src, sink, ck = tmp_path / "in", tmp_path / "out", tmp_path / "ck"
    src.mkdir()
    c = fixtures(spark, SF_SMALL).comments
    c.where(F.col("comment_id") % 2 == 0).coalesce(1).write.option("header", True).csv(str(src / "a"))
    ingest_csv(spark, str(src / "*"), str(sink), str(ck))
    n1 = spark.read.parquet(str(sink)).count()
    ingest_csv(spark, str(src / "*"), str(sink), str(ck))          # nothing new: no duplicates
    assert spark.read.parquet(str(sink)).count() == n1
    c.where(F.col("comment_id") % 2 == 1).coalesce(1).write.option("header", True).csv(str(src / "b"))
    ingest_csv(spark, str(src / "*"), str(sink), str(ck))
    assert spark.read.parquet(str(sink)).count() == c.count()
    back = read_comments(spark, str(sink), fmt="parquet")
    assert back.where(F.col("lat").isNull()).count() == c.where(F.col("lat").isNull()).count()
