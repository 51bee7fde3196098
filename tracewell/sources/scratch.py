"""Folders for intermediate tables, where every executor sees them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, or its checkpoint directory.

    Without either, a new folder of this machine if all of Spark runs in this process; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='tracewell-')}"
        _path(spark, _LOCAL[app])
    return _LOCAL[app]


def _path(spark: SparkSession, text: str):
    """A Hadoop path, deleted when the session ends, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(path)
    return path, fs


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new name under the shared folder; what is written there goes when the session ends."""
    text = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _path(spark, text)
    return text


def delete(spark: SparkSession, text: str) -> None:
    path, fs = _path(spark, text)
    fs.delete(path, True)
    fs.cancelDeleteOnExit(path)
