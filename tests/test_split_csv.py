"""CSV by byte ranges: equal to the multiLine reader for any place of the splits."""

import csv
import random
from collections import Counter

import pytest

from civiclens.sources import split_csv
from civiclens.sources.readers import COMMENT_TOPICS_SCHEMA, COMMENTS_SCHEMA, read_comment_topics, read_comments
from civiclens.streaming.ingest import ingest_comment_topics, ingest_csv

COLUMNS = ["id", "text", "note", "n"]
PARTS = ["word", "two words", "\n", "\n\n", '"', '""', ",", "é日本😀", " ", "'", "a\tb", "", "x" * 50, '"\n"', "\n,"]


def write(path, rows, columns=COLUMNS, end="\n", quoting=csv.QUOTE_MINIMAL, bom=False):
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=quoting)
        out.writerow(columns)
        out.writerows(rows)


def rows(seed, n=300):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))
    return [(i, text(), text(), rng.choice(["", "1", "x"])) for i in range(n)]


def whole(spark, path, columns=COLUMNS):
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return Counter(map(tuple, df.select(*columns).collect()))


@pytest.fixture
def small_splits(spark):
    """Splits of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


@pytest.mark.parametrize("kw", [{}, {"end": "\r\n"}, {"quoting": csv.QUOTE_ALL}, {"bom": True}])
def test_equal_to_the_whole_read(spark, tmp_path, small_splits, kw):
    path = str(tmp_path / "a.csv")
    write(path, rows(1), **kw)
    got = split_csv.read_split_csv(spark, path, COLUMNS)
    assert split_csv.splits(spark, path).count() > 20
    assert Counter(map(tuple, got.collect())) == whole(spark, path)


def test_record_over_many_splits(spark, tmp_path, small_splits):
    path = str(tmp_path / "a.csv")
    long = "line of text\n" * 200 + "end, with \"quotes\" and \n\n\n"
    write(path, [(1, "a", "b", ""), (2, long, "id,text,note,n", "1"), ("id", "text", "note", "n"), (3, "\n" * 700, long, "x"), (4, "z", "", "")])
    got = [tuple(r) for r in split_csv.read_split_csv(spark, path, COLUMNS).collect()]
    assert Counter(got) == whole(spark, path) and ("2", long, "id,text,note,n", "1") in got and ("id", "text", "note", "n") in got


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "a.csv")
    write(path, rows(2, 60_000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        got = split_csv.read_split_csv(spark, path, COLUMNS)
        assert got.rdd.getNumPartitions() > 8
        assert Counter(map(tuple, got.collect())) == whole(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_files_with_other_column_orders(spark, tmp_path, small_splits):
    write(tmp_path / "a.csv", rows(3))
    write(tmp_path / "b.csv", [(n, i, note, text) for i, text, note, n in rows(4)], ["n", "id", "note", "text"])
    (tmp_path / "empty.csv").write_text("")
    write(tmp_path / "header.csv", [])
    got = split_csv.read_split_csv(spark, str(tmp_path), COLUMNS)
    assert Counter(map(tuple, got.collect())) == whole(spark, str(tmp_path / "a.csv")) + whole(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="no column other"):
        split_csv.read_split_csv(spark, str(tmp_path), ["id", "other"])


def test_unbalanced_quotes_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,5" pipe\n')
    with pytest.raises(ValueError, match="odd number of quotes"):
        split_csv.read_split_csv(spark, str(tmp_path / "a.csv"), ["id", "text"])


def test_no_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    assert split_csv.read_split_csv(spark, str(tmp_path / "a.csv"), ["id"]).collect() == []


TOPICS = [(i, f"[{i}, -1]", "[0.5, nan]", "Camden", "a\nb" if i % 3 else "", i / 10) for i in range(200)]


def test_readers_and_pruned_columns(spark, tmp_path, small_splits):
    write(tmp_path / "t.csv", TOPICS, COMMENT_TOPICS_SCHEMA.names)
    got = read_comment_topics(spark, str(tmp_path / "t.csv"), cols=["comment_id", "topic_number"])
    assert got.columns == ["comment_id", "topic_number"] and Counter(map(tuple, got.collect())) == Counter((t[0], t[1]) for t in TOPICS)
    both = [Counter(map(tuple, read_comment_topics(spark, str(tmp_path / "t.csv"), split=s).collect())) for s in (True, False)]
    assert both[0] == both[1]


def test_ingest_by_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    names = ["comment_id", "text", "application_id", "council", "stance", "sentiment_score", "lat", "lon"]
    write(tmp_path / "in" / "a.csv", [(1, "hello\nthere", "APP1", "Camden", "Supports", "nan", 0.5, 51.5), (2, "x", "APP2", "Brent", "Objects", "bad", 1, 2)], names)
    places = [str(tmp_path / p) for p in ("in", "out", "ck")]
    ingest_csv(spark, *places)
    write(tmp_path / "in" / "b.csv", [("Neutral", 3, "APP3", "Camden", 0.25, 3, 4)], ["stance", "comment_id", "application_id", "council", "sentiment_score", "lat", "lon"])
    ingest_csv(spark, *places)
    ingest_csv(spark, *places)
    got = sorted(map(tuple, spark.read.parquet(places[1]).select(*COMMENTS_SCHEMA.names, "_rejected").collect()))
    assert got == [(1, "APP1", "Camden", "Supports", None, 0.5, 51.5, False), (2, "APP2", "Brent", "Objects", None, 1.0, 2.0, True),
                   (3, "APP3", "Camden", "Neutral", 0.25, 3.0, 4.0, False)]


def test_ingest_topics(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "t.csv", TOPICS, COMMENT_TOPICS_SCHEMA.names)
    ingest_comment_topics(spark, *[str(tmp_path / p) for p in ("in", "out", "ck")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(TOPICS)


def test_read_comments_split_equals_whole(spark, tmp_path, small_splits):
    write(tmp_path / "c.csv", [(i, f"A{i}\n{i}", "Camden", '"Supports"', i, "", "nan") for i in range(100)], COMMENTS_SCHEMA.names)
    a, b = (Counter(map(tuple, read_comments(spark, str(tmp_path / "c.csv"), split=s, rejects=True).collect())) for s in (True, False))
    assert a == b and sum(a.values()) == 100


def test_topic_names_and_parquet_readers(spark, tmp_path):
    """Lookup with its order; S5: columns by name, also the dotted one, rejected values marked."""
    from pyspark.sql import functions as F

    from civiclens.sources.readers import APPLICATIONS_SCHEMA, PLD_SCHEMA, read_parquet, read_topic_names, reject_count
    write(tmp_path / "n.csv", [("#111111", 7, "parks, trees", 10), ("#222222", -1, "", 30), ("#333333", 2, 'the "other"\nhalf', 30)], ["color", "Topic", "topic_group", "Count"])
    got = sorted(map(tuple, read_topic_names(spark, str(tmp_path / "n.csv")).collect()))
    assert got == [(-1, 30, None, "#222222", 0), (2, 30, 'the "other"\nhalf', "#333333", 1), (7, 10, "parks, trees", "#111111", 2)]
    ring = [[0.0, 51.0], [1.0, 51.0], [1.0, 52.0]]
    rows = [("Market housing", "12", [ring], "APP1", "Camden"), (None, "many", None, "APP2", "Brent")]
    spark.createDataFrame(rows, "housing_type string, total_no_proposed_residential_units string, `wgs84_polygon.coordinates` array<array<array<double>>>, lpa_app_no string, borough string") \
        .write.parquet(str(tmp_path / "pld"))
    pld = read_parquet(spark, str(tmp_path / "pld"), PLD_SCHEMA, rejects=True)
    assert pld.columns[:-1] == PLD_SCHEMA.names and tuple(reject_count(pld).first()) == (2, 1)
    first = pld.orderBy("lpa_app_no").select(F.col("total_no_proposed_residential_units"), F.col("`wgs84_polygon.coordinates`")[0][0][1]).collect()
    assert [tuple(r) for r in first] == [(12, 51.0), (None, None)]
    with pytest.raises(Exception, match="comment_count"):
        read_parquet(spark, str(tmp_path / "pld"), APPLICATIONS_SCHEMA).collect()
