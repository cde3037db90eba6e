"""SparkSession construction and lineage helpers.

The session settings are the ones the operators assume: ANSI mode (so bad
casts must go through ``try_cast``), UTC session time zone, adaptive query
execution with partition coalescing and skew-join splitting, and no web UI.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every session built here carries.  Shuffle partitions are sized
# for the cluster by the caller; AQE coalesces small ones at runtime.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(total_cores: int, target_partition_mb: int = 256) -> dict[str, str]:
    """Settings for a large cluster, sized from the total executor cores.

    Shuffle partitions start at 3x the cores (AQE then coalesces small ones
    towards the advisory size and splits skewed ones); scan splits and the
    advisory shuffle partition are ``target_partition_mb`` so a task's
    working set stays well inside executor memory.
    """
    size = f"{target_partition_mb}m"
    return {
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": size,
        "spark.sql.autoBroadcastJoinThreshold": "64m",
    }


def build_session(master: str = "local[*]", app_name: str = "tabulant",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's base settings."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``, set at most once a session.

    ``setCheckpointDir`` makes a new folder on every call, so a folder that is
    already set is kept.  Only a one-machine session without the setting gets
    a private folder; a session with executors of its own must name one, since
    a machine-local folder would not survive the loss of that machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster file system)")
        configured = tempfile.mkdtemp(prefix="tabulant-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into the reliable checkpoint folder.

    Used where a derived table is read by several later branches; a reliable
    checkpoint survives executor loss (unlike ``localCheckpoint``).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
