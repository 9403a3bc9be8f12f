"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession

_LOCK = threading.Lock()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "pricelens") -> SparkSession:
    """Build (or reuse) a session tuned for the listings jobs.

    On a cluster the master, memory and checkpoint folder come from
    spark-submit; only local runs fill them in here.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    # The number of shuffle partitions is the caller's; only a new local
    # session that names none gets a small one.
    asked = shuffle_partitions or os.environ.get("PRICELENS_SHUFFLE_PARTITIONS")
    if not asked and SparkSession.getActiveSession() is None and is_local(master or ""):
        asked = 8
    if asked:
        builder = builder.config("spark.sql.shuffle.partitions", str(asked))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """One process, one machine: ``local`` or ``local[n]`` (``local-cluster`` has executors of its own)."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and landed tables.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir).  Only
    when neither is set -- local runs and tests -- a fresh folder is made.
    """
    with _LOCK:
        sc = spark.sparkContext
        current = sc.getCheckpointDir()
        if current:
            return current
        conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if conf:
            sc.setCheckpointDir(conf)
            return sc.getCheckpointDir() or conf
        if not is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
        local = tempfile.mkdtemp(prefix="pricelens-ckpt-")
        sc.setCheckpointDir(local)
        return sc.getCheckpointDir() or local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the checkpoint folder."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet under the checkpoint folder and read back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
