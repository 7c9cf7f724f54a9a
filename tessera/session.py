"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Settings the library relies on; a cluster deployment may override sizes
# (shuffle partitions, max partition bytes) but should keep the semantics ones.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

PERFORMANCE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    # Size-checked automatic broadcast only; explicit broadcast() hints are
    # reserved for rule tables whose size is fixed by construction.
    "spark.sql.autoBroadcastJoinThreshold": str(10 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "tessera") -> SparkSession:
    """Local/test session builder. On a cluster use the session you are given."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.appName(app_name)
    if master or not SparkConf().contains("spark.master"):
        builder = builder.master(master or f"local[{cpus}]")
    conf = {**SEMANTIC_CONF, **PERFORMANCE_CONF}
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    conf["spark.driver.memory"] = os.environ.get("TESSERA_DRIVER_MEMORY", "16g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the semantic settings to an existing session (e.g. the driver's)."""
    for k, v in SEMANTIC_CONF.items():
        spark.conf.set(k, v)
    return spark


MB_PER_PARTITION = 16
SKEWED = 4  # a join's partition of this many times that size is split


def size_shuffles(spark: SparkSession, sf_dir: str) -> int:
    """Let shuffle partitions grow with the input, so a task's memory doesn't.

    One for every ``MB_PER_PARTITION`` of the folder's files, never fewer than the session has; AQE
    joins small ones, up to that size: texts that repeat take many times it in memory; a join's hot
    partition is split from ``SKEWED`` times that size on (Spark's own 256 MB goes with its 64 MB). Sizes come from
    Spark's file listing; the files' content isn't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sf_dir)
    total = files.agg(F.sum("length")).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // (MB_PER_PARTITION << 20)))
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(MB_PER_PARTITION << 20))
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", str(SKEWED * MB_PER_PARTITION << 20))
    return n


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Where it is unset, a private folder stands in, but only in local mode (tests),
    where driver and executors are one process; on a cluster that is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tessera-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current
