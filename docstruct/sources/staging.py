"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared folder.

    That is ``spark.checkpoint.dir``; where it is unset, the warehouse, which the session
    shares with its executors as well. Never a machine's temporary folder.
    """
    base = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/docstruct/{name}-{uuid.uuid4().hex}"


def stage_at(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` to ``path`` and read it back; whoever chose the path deletes it."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    For results with several consumers: they scan the columns they need instead of
    repeating the shuffles, and a lost executor costs no more than its own tasks.
    """
    return stage_at(df, shared_dir(df.sparkSession, name))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through the file system it is on."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
