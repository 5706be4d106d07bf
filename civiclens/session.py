"""Session construction and cluster-facing settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a cluster job wants regardless of size. Shuffle partitions are left to
# the caller: on a cluster they come from spark-defaults, locally from `cpus`.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Runtime broadcast conversion is the size-checked broadcast: AQE only turns a
    # sort-merge join into a broadcast join once the measured side is below this.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    # Staged geometry adds many aliased columns; constraint inference over them grows
    # combinatorially and brings nothing to these plans.
    "spark.sql.constraintPropagation.enabled": "false",
    # Checkpoint files (exact-quantile numbering, materialised inputs) are removed
    # once their data is no longer referenced, so the shared folder does not fill up.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app_name: str = "civiclens", driver_memory: str = "16g") -> SparkSession:
    """Local session for tests and the benchmark (single JVM)."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app_name)
    for key, value in _SCALE_CONF.items():
        builder = builder.config(key, value)
    n = shuffle_partitions or (int(cpus) if str(cpus).isdigit() else 8)
    # Locally the shuffle partitions already equal the cores, so coalescing can only
    # lower parallelism; it would put CPU-heavy stages (kernel sums, ray tests,
    # projections) on a few tasks because AQE sizes partitions by input bytes. On a
    # cluster the session's own settings apply (coalescing on, partitions sized to
    # the data).
    builder = (builder.config("spark.sql.shuffle.partitions", str(n))
               .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
               .config("spark.driver.memory", driver_memory))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by `spark.checkpoint.dir`.

    On a cluster the folder is set by the cluster (a shared file system path) and
    is only read here. Only in a local session without the setting (tests, bench) a
    scratch folder is created; elsewhere a missing setting is an error, because
    executors cannot see each other's disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="civiclens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path
