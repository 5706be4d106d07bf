"""Readers for the analysis inputs, with explicit schemas (no inference)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiclens.sources.split_csv import read_split_csv
from civiclens.sources.split_json import head, objects

COMMENTS_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("application_id", T.StringType()),
    T.StructField("council", T.StringType()),
    T.StructField("stance", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
])

COMMENT_TOPICS_SCHEMA = T.StructType([
    T.StructField("comment_id", T.LongType()),
    T.StructField("topic_number", T.StringType()),
    T.StructField("probability", T.StringType()),
    T.StructField("council", T.StringType()),
    T.StructField("housing_type", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
])

TOPIC_NAMES_SCHEMA = T.StructType([
    T.StructField("Topic", T.IntegerType()),
    T.StructField("Count", T.LongType()),
    T.StructField("topic_group", T.StringType()),
    T.StructField("color", T.StringType()),
])

_POLYGON = "array<array<array<double>>>"
_MULTIPOLYGON = "array<array<array<array<double>>>>"


#: Column that marks rows with a value that its type rejects (see `reject_count`).
REJECTED = "_rejected"


def _by_name(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, found by name whatever their order, cast without failing. A text that its
    type rejects becomes NULL and marks the row; NaN becomes NULL, unmarked. A missing column is an error."""
    out, bad = [], F.lit(False)
    for f in schema.fields:
        raw = F.col(f"`{f.name}`")
        value = raw.try_cast(f.dataType)
        bad = bad | (raw.isNotNull() & value.isNull())
        out.append((F.nanvl(value, F.lit(None)) if f.dataType == T.DoubleType() else value).alias(f.name))
    return df.select(*out, bad.alias(REJECTED))


def _csv(spark: SparkSession, path: str | Sequence[str], cols: Sequence[str], split: bool) -> DataFrame:
    # Every column is read as text under its header's name. Free text may contain line feeds: files are split by
    # byte ranges all the same (sources.split_csv), or read whole with multiLine.
    if split:
        return read_split_csv(spark, path, cols)
    return (spark.read.option("header", True).option("inferSchema", False).option("multiLine", True)
            .option("escape", '"').csv(path))


def _read(spark: SparkSession, schema: T.StructType, path: str | Sequence[str], fmt: str, cols: list[str] | None = None,
          rejects: bool = False, split: bool = False) -> DataFrame:
    wanted = T.StructType([f for f in schema.fields if not cols or f.name in cols])
    df = _by_name(_csv(spark, path, wanted.names, split) if fmt == "csv" else spark.read.parquet(path), wanted)
    return df.select(*(cols or schema.names), *([REJECTED] if rejects else []))


def read_csv(spark: SparkSession, schema: T.StructType, path: str | Sequence[str], rejects: bool = False, split: bool = True) -> DataFrame:
    """CSV files with the columns of a schema, by name."""
    return _read(spark, schema, path, "csv", None, rejects, split)


def reject_count(df: DataFrame) -> DataFrame:
    """One row: n_rows and n_rejected of a table read with rejects=True."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(REJECTED).alias("n_rejected"))


def read_comments(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv", rejects: bool = False, split: bool = True) -> DataFrame:
    """Comments with stance, sentiment and commenter coordinates; NaN becomes NULL. CSV files are split by byte
    ranges; split=False reads each whole (for files whose quotes are not doubled)."""
    return _read(spark, COMMENTS_SCHEMA, path, fmt, None, rejects, split)


def read_comment_topics(spark: SparkSession, path: str | Sequence[str], cols: list[str] | None = None,
                        fmt: str = "csv", rejects: bool = False, split: bool = True) -> DataFrame:
    """Comments with topic lists as text; `cols` prunes columns at the scan (only those are looked for). split as for
    `read_comments`."""
    return _read(spark, COMMENT_TOPICS_SCHEMA, path, fmt, cols, rejects, split)


def normalise_topic_names(df: DataFrame) -> DataFrame:
    """Rename the lookup's id and count (identifiers are case-insensitive, so `Topic`
    would clash with an exploded `topic`) and add `file_order`: Count desc, Topic asc."""
    from pyspark.sql import Window
    out = df.select(F.col("Topic").cast("int").alias("topic_id"),
                    F.col("Count").cast("long").alias("topic_count"),
                    "topic_group", "color")
    # The lookup has one row per topic of the topic model (hundreds at most), so a
    # single-partition window is bounded.
    w = Window.orderBy(F.desc("topic_count"), F.asc("topic_id"))
    return out.withColumn("file_order", (F.row_number().over(w) - 1).cast("long"))


def read_topic_names(spark: SparkSession, path: str) -> DataFrame:
    """Topic id -> group label and colour."""
    return normalise_topic_names(_read(spark, TOPIC_NAMES_SCHEMA, path, "csv"))


APPLICATIONS_SCHEMA = T.StructType([
    T.StructField("lpa_app_no", T.StringType()),
    T.StructField("borough", T.StringType()),
    T.StructField("housing_type", T.StringType()),
    T.StructField("total_no_proposed_residential_units", T.IntegerType()),
    T.StructField("comment_count", T.LongType()),
])

PLD_SCHEMA = T.StructType([*APPLICATIONS_SCHEMA.fields[:4],
                           T.StructField("wgs84_polygon.coordinates", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType, rejects: bool = False) -> DataFrame:
    """Applications (APPLICATIONS_SCHEMA) or pld (PLD_SCHEMA), columns by name. The pld coordinate
    column name contains a dot: refer to it as F.col("`wgs84_polygon.coordinates`"). rejects: also the mark of rows with
    a value that its type rejects (see `reject_count`)."""
    rows = _by_name(spark.read.parquet(path), schema)
    return rows if rejects else rows.drop(REJECTED)


#: Reference system of GeoJSON coordinates unless the file says otherwise.
WGS84 = "EPSG:4326"


def geojson_crs(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The reference system that a `crs` member in front of the features names, as "EPSG:n"; WGS84 without one."""
    found = re.search(r'"crs"\s*:\s*\{.*?"name"\s*:\s*"([^"]+)"', head(spark, path), re.S)
    code = found and re.search(r"EPSG:+(\d+)$", found[1])
    return f"EPSG:{code[1]}" if code else WGS84


def read_geojson(spark: SparkSession, path: str | Sequence[str], props: list[str], crs: str | None = None, split: bool = True) -> DataFrame:
    """FeatureCollection -> one row per feature with the named properties and
    `parts` (MultiPolygon shape: parts -> rings -> points -> [x, y]).

    The coordinates are declared as text and decoded per geometry type, so Polygon
    and MultiPolygon features can share one file. Files are split by byte ranges (sources.split_json); split=False
    reads each whole. The metadata of `parts` name the reference system: `crs`, or what the file says."""
    feature = T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.StructType([T.StructField(p, T.StringType()) for p in props])),
        T.StructField("geometry", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("coordinates", T.StringType()),
        ])),
    ])
    if split:
        feats = objects(spark, path).select(F.from_json("text", feature).alias("f")).where("f.type = 'Feature'")
    else:
        feats = (spark.read.schema(T.StructType([T.StructField("features", T.ArrayType(feature))])).option("multiLine", True).json(path)
                 .select(F.explode("features").alias("f")))
    gtype = F.col("f.geometry.type")
    coords = F.col("f.geometry.coordinates")
    parts = (F.when(gtype == "Polygon", F.array(F.from_json(coords, _POLYGON)))
             .when(gtype == "MultiPolygon", F.from_json(coords, _MULTIPOLYGON)))
    return feats.select(*[F.col(f"f.properties.`{p}`").alias(p) for p in props],
                        gtype.alias("geometry_type"), parts.alias("parts", metadata={"crs": crs or geojson_crs(spark, path)}))


def read_census(spark: SparkSession, path: str, counts: list[str], key: str = "LSOA code", fmt: str = "csv") -> DataFrame:
    """A census sheet exported to CSV or Parquet: the area code and the named count columns, as
    whole numbers (a thousands comma is taken out)."""
    raw = spark.read.parquet(path) if fmt == "parquet" else spark.read.option("header", True).option("inferSchema", False).csv(path)
    number = lambda c: F.replace(F.col(f"`{c}`").cast("string"), F.lit(","), F.lit("")).try_cast("long").alias(c)
    return raw.select(F.col(f"`{key}`").cast("string").alias(key), *[number(c) for c in counts])
