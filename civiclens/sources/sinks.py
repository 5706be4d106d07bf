"""K1, K3: publish the tables behind the figures; previews and counts.

Tables are published together: each is written to a new folder, then one small manifest that names the folders is
put in place of the old one, in one step. A run that fails on the way leaves the old manifest and its tables as they were, and
readers see either all old or all new tables."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_published"


def _file_system(spark: SparkSession, place: str):
    """Hadoop's file context and path of a place, whatever store it is in."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(place)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf), path


def _put(spark: SparkSession, place: str, text: str) -> None:
    """A small file, complete or not at all: written beside its place and renamed over what is there."""
    jvm = spark._jvm
    context, path = _file_system(spark, place)
    options, flags = jvm.org.apache.hadoop.fs.Options, jvm.org.apache.hadoop.fs.CreateFlag
    own = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}-{uuid.uuid4().hex}")
    parents = spark.sparkContext._gateway.new_array(options.CreateOpts, 1)
    parents[0] = options.CreateOpts.createParent()
    out = context.create(own, jvm.java.util.EnumSet.of(flags.CREATE), parents)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(options.Rename, 1)
    over[0] = options.Rename.OVERWRITE
    context.rename(own, path, over)


def _manifests(spark: SparkSession, results_dir: str) -> dict[str, dict]:
    """All manifests of a results folder, by file name."""
    context, path = _file_system(spark, f"{results_dir.rstrip('/')}/{MANIFESTS}")
    if not context.util().exists(path):
        return {}
    files = [f.getPath().toString() for f in context.util().listStatus(path) if not f.getPath().getName().startswith(".")]
    return {r["path"].rsplit("/", 1)[-1]: json.loads(bytes(r["content"])) for r in spark.read.format("binaryFile").load(files).select("path", "content").collect()} if files else {}


def publish(frames: dict[str, DataFrame], results_dir: str, name: str, prefix: str = "") -> dict[str, str]:
    """Write the frames as Parquet tables `prefix + key` and publish them under the manifest `name`, in place of
    what it named before. Returns their paths. Folders of former versions stay until `prune`."""
    root, version = results_dir.rstrip("/"), f"{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"
    paths = {}
    for key, df in frames.items():
        paths[key] = f"{root}/{prefix}{key}/{version}"
        df.write.parquet(paths[key])
    if frames:
        spark = next(iter(frames.values())).sparkSession
        _put(spark, f"{root}/{MANIFESTS}/{name}.json", json.dumps({"version": version, "tables": [f"{prefix}{key}" for key in frames]}))
    return paths


def write_result(df: DataFrame, results_dir: str, name: str) -> str:
    """K1: publish one table."""
    return publish({name: df}, results_dir, name)[name]


def published(spark: SparkSession, results_dir: str) -> dict[str, str]:
    """Path of each published table of a results folder."""
    found = sorted(_manifests(spark, results_dir).values(), key=lambda m: m["version"])
    return {t: f"{results_dir.rstrip('/')}/{t}/{m['version']}" for m in found for t in m["tables"]}


def read_result(spark: SparkSession, results_dir: str, name: str) -> DataFrame:
    """A published table."""
    return spark.read.parquet(published(spark, results_dir)[name])


def prune(spark: SparkSession, results_dir: str) -> list[str]:
    """Delete versions of published tables that no manifest names any more, also those of failed runs. Not while a run writes."""
    gone = []
    for table, current in published(spark, results_dir).items():
        context, path = _file_system(spark, f"{results_dir.rstrip('/')}/{table}")
        for f in context.util().listStatus(path):
            if f.getPath().getName() != current.rsplit("/", 1)[-1]:
                gone.append(f.getPath().toString())
                context.delete(f.getPath(), True)
    return gone


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """K3: the first rows."""
    return df.limit(n)


def row_count(df: DataFrame) -> DataFrame:
    """K3: one row, n_rows."""
    return df.agg(F.count("*").alias("n_rows"))
