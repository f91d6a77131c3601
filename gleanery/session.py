"""Session set-up and the few cluster-wide helpers the operators share."""

from __future__ import annotations

import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more exchange above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Raw pages are large: bound what one Arrow batch holds by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64MB",
}


def build_session(master: str | None = None, app: str = "gleanery", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    # Site definitions compile to many small column calls; do not trace each one.
    fixed = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
    for key, value in {**SETTINGS, **fixed, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def self_contained(module_name: str) -> None:
    """Send the functions of a module to executors whole, so they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a session in local mode, where driver and executors are one process, may
    do without the setting and gets a folder of its own; on a cluster, and so in
    ``local-cluster`` mode, an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="gleanery-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written copy."""
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt anew in partitions of about ``advisoryPartitionSizeInBytes``, before they are sorted or held.

    Rows that repeat each other take so little in a file that one split may hold any number of them; partitions
    after an exchange go by the bytes of rows.
    """
    return df.hint("rebalance")


#: Estimated bytes up to which a table is dealt anew over the cores.
SMALL_SCAN = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """Use every core for costly work on rows where a small scan has fewer splits than cores.

    A table that the optimizer does not know to be small is returned untouched, so
    raw pages are never shuffled at scale; there the size of splits is the user's
    ``spark.sql.files.maxPartitionBytes``.
    """
    spark = df.sparkSession
    estimate = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(estimate)) > SMALL_SCAN:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)
