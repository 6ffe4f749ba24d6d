"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path under ``spark.checkpoint.dir``; only a local session may leave that unset and gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spanwise-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/spanwise/{uuid.uuid4().hex}"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path in the shared folder, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` read back from the Parquet that it is written to, and where that is."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read back. Cuts the lineage of iterations; lost executors lose nothing."""
    return written(df)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete what ``written`` left at ``path`` and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
