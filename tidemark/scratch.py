"""Tables written to the folder that all executors share, to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder of ``spark.checkpoint.dir``; a local one of our own only where that is unset and all runs on one machine."""
    base = spark.conf.get(CONF, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"{CONF} must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(CONF, base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    What follows reads files instead of recomputing, so a lost executor costs its own tasks only, and ids
    that depend on the order of rows stay as they were written.
    """
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Lets the shuffle files of what has been written go now, not when the driver next happens to collect its garbage."""
    gc.collect()
    for _ in range(2):  # what the first frees lets go of the rest
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


def discard(df: DataFrame) -> None:
    """Deletes what :func:`saved` wrote for ``df``; nothing that still has to run may read it."""
    spark = df.sparkSession
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """The pyarrow file system and path of a URI, for tasks that write or seek in files of their own.

    Hadoop's names of a scheme (``s3a``, ``s3n``) are read as pyarrow's; a scheme that it doesn't know raises
    ValueError, so callers try their folder on the driver first.
    """
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if sep and scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return fs.FileSystem.from_uri(uri if sep or uri.startswith("/") else uri.replace("file:/", "file:///", 1))
