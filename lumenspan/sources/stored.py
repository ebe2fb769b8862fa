"""Folders of Parquet tables that change: listed, replaced and pointed to by way of Spark's own file systems."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares; a session on one machine that names none gets a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lumenspan-tables-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        named = _own[app]
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def folders(spark: SparkSession, path: str, prefix: str) -> dict[int, str]:
    """The complete folders `<prefix>=<number>` in a folder, by number: those that a writer has marked as finished."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    found = {}
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith(f"{prefix}=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
            found[int(name.split("=")[1])] = f"{path}/{name}"
    return found


def children(spark: SparkSession, path: str) -> list[str]:
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def put(frame: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """Write a folder anew; a repeated write replaces it."""
    writer = frame.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
