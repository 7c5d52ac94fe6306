"""SparkSession settings used by tests, the bench and the examples.

On a cluster the session already exists and carries the cluster's settings; these helpers only
fill in what is unset, so a job never overrides the shared checkpoint folder or the partition
sizing chosen for the cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every operator relies on. AQE re-plans joins and coalesces shuffle partitions at
# run time from the real sizes, splits skewed join partitions, and turns a sort-merge join into
# a broadcast join only when the measured side is under the threshold (a checked size).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that needs an extra shuffle (hot run / repo keys)
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    # Streaming state (the run table of the streaming upsert, dedupe keys, window counts) lives in
    # RocksDB off the JVM heap, and each micro-batch checkpoints only its changes.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "runlens",
                  extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "8g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def cluster_session(app: str = "runlens") -> SparkSession:
    """The session of a submitted job: the master and every setting that the cluster or the user
    gave stay as they are; only settings that are not set take this library's defaults."""
    spark = SparkSession.builder.appName(app).getOrCreate()
    fill_unset(spark)
    ensure_checkpoint_dir(spark)
    return spark


def fill_unset(spark: SparkSession) -> None:
    """Set the session settings of ``DEFAULT_CONF`` that nobody has set."""
    given = {k for k, _ in spark.sparkContext.getConf().getAll()}
    for k, v in DEFAULT_CONF.items():
        if k not in given and spark.conf.isModifiable(k):
            spark.conf.set(k, v)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the cluster (a shared file system path). Only when it is unset,
    as in local tests, a fresh scratch folder is made for this process.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) that every "
                               "executor and the driver can reach; a machine-local folder would not survive "
                               "a lost executor")
        current = tempfile.mkdtemp(prefix="runlens-ckpt-")  # local mode only (tests)
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written tables and stream state."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def cluster_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Shuffle sizing for a cluster run, from the input size.

    The initial shuffle partition count is set so that each partition holds about
    ``partition_bytes`` of input (and there are at least three per core). AQE then coalesces
    small partitions and splits skewed ones at run time, using the same advisory size, so a
    partition fits in executor memory and a spill stays bounded. Scan splits use the same size.
    """
    parts = max(3 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": str(partition_bytes // 4),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(partition_bytes * 2),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
    }
