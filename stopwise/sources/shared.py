"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; only in local mode may a temporary folder stand in for it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def present(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, whatever its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def stored(df: DataFrame, name: str = "stored", path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read again, so that later steps neither recompute it nor depend on an executor.

    Rows of each value of the columns ``by`` get files of their own, and who asks for one value reads no others.
    """
    path = path or shared_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    return out.select(*df.columns) if by else out
