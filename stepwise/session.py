"""Session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Session defaults for iterative jobs.  AQE stays on: it coalesces the
# small shuffles of late supersteps and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of step states that are no longer referenced are
    # deleted, so long loops do not fill the shared checkpoint folder
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, app: str = "stepwise",
                  shuffle_partitions: int | None = None,
                  conf: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that holds reliable checkpoints.

    Uses the directory the cluster names in ``spark.checkpoint.dir`` (or one
    already set on the context).  Only a local session without one gets a
    private temporary folder; a cluster session without one is an error,
    because a machine-local folder does not survive the loss of a node.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; name a shared folder for iteration state")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stepwise-ckpt-"))
    return sc.getCheckpointDir()


def default_partitions(spark: SparkSession) -> int:
    """Partition count for loop-invariant inputs: the shuffle partition count."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder next to the checkpoints for staged state (shared storage)."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "stepwise-" + name)
