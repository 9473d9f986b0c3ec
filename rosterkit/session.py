"""Session defaults and the shared staging folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(app: str = "rosterkit", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; a running session is reused."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Rows here are small but costly (dates, patterns), so partitions are merged less eagerly than by default.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # Call-site capture costs more than everything else when large expressions are built.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master, where driver and executors are one process.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if root:
        return root.rstrip("/")
    if not re.match(r"^local(\[|$)", spark.sparkContext.master):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="rosterkit-")
    spark.conf.set(CHECKPOINT_CONF, root)
    return root


def staging_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder.

    All paths of one application share a folder, which can be removed when the application has ended.
    """
    return f"{staging_root(spark)}/rosterkit-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage durably (a lost executor costs a re-read, not a re-run), fixes values that would
    differ between two evaluations, and gives the optimizer real sizes for the joins that follow.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
