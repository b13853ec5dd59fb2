"""Session settings and the shared folder used for checkpoints and staged tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: str | int = 8, app: str = "eventide") -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's session is used as is."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or a temp folder in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a staged table, unique per call so that reruns never collide."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and fixes the rows against re-evaluation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int = 0, a_task: int = 250_000) -> DataFrame:
    """Deal narrow rows that are about to expand evenly over the session's shuffle partitions, or over more of them, so that
    of `rows` rows a task gets about `a_task` at every size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, -(-rows // a_task)), *keys)
