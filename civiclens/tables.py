"""Intermediate tables as Parquet in the shared folder (spark.checkpoint.dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from civiclens.session import ensure_checkpoint_dir


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once and read again: cuts the lineage, keeps column pruning, survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str = "table", **conditions: Column) -> tuple[DataFrame, DataFrame]:
    """`stored(df)`, and a row of n_rows and the number of rows that meet each condition, counted by the pass that writes."""
    seen = Observation(name)
    table = stored(df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()]), name)
    counts = {k: int(v) for k, v in seen.get.items()}
    return table, df.sparkSession.createDataFrame([tuple(counts[k] for k in ("n_rows", *conditions))], ", ".join(f"{k} long" for k in ("n_rows", *conditions)))
