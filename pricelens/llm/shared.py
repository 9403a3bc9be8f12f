"""Helpers shared by the training-data operators: tables and the shared folder.

Files that executors write and others read go to the folder the cluster
names in ``spark.checkpoint.dir``; they are reached through ``pyarrow.fs``
so that any store it knows (local, HDFS, S3, ...) works from any executor.
"""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from pricelens.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new, unique URI under the shared checkpoint folder."""
    path = scratch_path(spark, name)
    return path if "://" in path else path.replace("file:", "file://") if path.startswith("file:") else f"file://{path}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet under the shared folder and read back.

    Cuts the lineage at a place every executor can reach, so a lost executor
    costs only its own running tasks.
    """
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def unique_name(prefix: str, suffix: str) -> str:
    """A name no other task attempt uses; only names that a committed task
    reports are ever read, so files of failed attempts are never seen."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
