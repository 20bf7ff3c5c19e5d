"""Session settings the jobs rely on, and the one place that resolves checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable SQL options. Partition counts are left to the deployment:
# AQE coalesces small shuffles and splits skewed ones from whatever is set.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # lists of keys reach the row groups' statistics and dictionaries
    "spark.sql.parquet.pushdown.inFilterThreshold": "5000",
    # partition values such as agency codes stay strings
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the SQL options the operators assume (UTC, AQE, skew joins)."""
    for key, value in SQL_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; fall back only when none is named.

    ``spark.checkpoint.dir`` names shared storage on a cluster. A temporary
    folder is created only for a local master, where it is the shared storage.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to shared storage to run iterative jobs")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and keeps loop plans short."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
