"""Where the library writes what it reads again: the folder that a cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder; in local mode without one, in a temporary folder. What is written there goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{_local()}"
    path = f"{folder.rstrip('/')}/sitemill-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df as a table that was written and is read again: for what several parts of a plan need, so that it is made once."""
    at = scratch_path(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def _local() -> str:
    global _own
    _own = _own or tempfile.mkdtemp(prefix="sitemill-")
    return _own


_own: str | None = None


def file_system(spark: SparkSession, path: str):
    """The store of a path, as Spark sees it, and the path there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        fs, at = file_system(spark, path)
        fs.delete(at, True)
    except Exception:  # the session may be gone
        pass
