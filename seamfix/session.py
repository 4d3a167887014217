"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(master: str | None = None, partitions: int = 8) -> SparkSession:
    """Session for tests and the bench; on a cluster use the cluster's own."""
    builder = SparkSession.builder.appName("seamfix")
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Read from the session. Unset, a single-process ``local`` master (tests)
    gets a private folder; on a cluster that is an error, as its executors
    share no local folder.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="seamfix-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(conf)
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared folder for a written table."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df, name: str = "cut"):
    """Cut lineage with a written Parquet table in the shared folder.

    One job writes it (a reliable ``checkpoint()`` would compute the plan
    twice: once to count, once to write); the re-read gets column pruning
    and filter pushdown, and survives executor loss. Used on small per-file
    decision frames that several branches reuse and on derived inputs;
    never ``localCheckpoint``."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
