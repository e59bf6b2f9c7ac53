"""Shared scratch folders: all intermediate tables live where every executor can reach them."""

from __future__ import annotations

import gc
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    root = spark.conf.get(SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder that all executors share")
    return _local_folder(spark.sparkContext.applicationId).name


@cache
def _local_folder(application: str) -> tempfile.TemporaryDirectory:
    """Removed when the Python process ends."""
    return tempfile.TemporaryDirectory(prefix=f"flowtide-{application}-", ignore_cleanup_errors=True)


_MADE: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove_scratch(spark: SparkSession) -> int:
    """Delete the folders that this application got from ``fresh_dir``; says how many there were.

    For the end of a job: tables that are read from them, the results of operators included, are gone then.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        folder = jvm.org.apache.hadoop.fs.Path(path)
        removed += folder.getFileSystem(conf).delete(folder, True)
    return removed


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, kept when executors are lost."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over.

    It does so once the driver's garbage collection finds their plans gone, and a driver with room seldom collects: a job of
    many queries that calls this between them holds the files of a few at a time, not of all. Tables stay readable.
    """
    for _ in range(2):  # the first round lets go of what the driver's Python held
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def move_into_place(spark: SparkSession, path: str, target: str) -> bool:
    """Rename a finished folder, unless there is none or the target is there already; says whether it did."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, goal = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(target)
    files = source.getFileSystem(conf)
    if files.exists(goal) or not files.exists(source):
        return False
    files.mkdirs(goal.getParent())
    return files.rename(source, goal)
