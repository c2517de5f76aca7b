"""Folders that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one machine, may fall
    back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return tempfile.mkdtemp(prefix="tickloom-")
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def new_folder(spark: SparkSession, purpose: str) -> str:
    """A path nobody has used yet; whoever writes to it creates it."""
    return f"{shared_root(spark)}/tickloom/{purpose}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table, where the cluster keeps it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def make_folder(spark: SparkSession, path: str) -> str:
    """Create a folder, where the cluster keeps it, unless it is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return path


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(target):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(target))


def moved(spark: SparkSession, path: str, target: str) -> bool:
    """Give a folder its final name, at once or not at all; False if that name is taken."""
    source, final = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, target))
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(final) and files.rename(source, final)
