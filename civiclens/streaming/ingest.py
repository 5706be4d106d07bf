"""CSV drops -> Parquet, incrementally (S1's "convert to Parquet once").

A file-source stream lists each new file once; its checkpoint (in the shared checkpoint folder) records which
files are done. A batch's files are read by byte ranges and by column name (`sources.split_csv`), so one large file is
work for all cores and the order of its columns does not matter. Each batch goes to a folder of its
own, which a repeated batch replaces: a restarted or partially failed run neither loses nor
duplicates rows. The column `_rejected` marks rows with a value that its type rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from civiclens.sources.readers import COMMENTS_SCHEMA, COMMENT_TOPICS_SCHEMA, read_csv


def ingest_csv(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str,
               schema: T.StructType = COMMENTS_SCHEMA, max_files_per_trigger: int = 64,
               wait: bool = True, split: bool = True):
    """Process every CSV file in `src_dir` not yet ingested, then stop
    (availableNow trigger). Returns the StreamingQuery. split=False reads each file whole."""
    # only paths are read of this source, no contents
    files = (spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
             .option("maxFilesPerTrigger", max_files_per_trigger).load(src_dir).select("path"))

    def write(batch: DataFrame, batch_id: int) -> None:
        paths = [r["path"] for r in batch.where("path not like '%/\\_%'").collect()]  # at most max_files_per_trigger
        if paths:
            read_csv(batch.sparkSession, schema, paths, rejects=True, split=split).write.mode("overwrite").parquet(
                f"{sink_dir.rstrip('/')}/batch={batch_id}")

    q = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        q.awaitTermination()
    return q


def ingest_comment_topics(spark: SparkSession, src_dir: str, sink_dir: str, checkpoint: str, **kw):
    """Same for comments_with_topics files (list columns stay text until parsed)."""
    return ingest_csv(spark, src_dir, sink_dir, checkpoint, schema=COMMENT_TOPICS_SCHEMA, **kw)
