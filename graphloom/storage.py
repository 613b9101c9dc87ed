"""Shared scratch storage.

Intermediate results that are read more than once are written as Parquet below
``spark.checkpoint.dir``, the one folder that the driver and every executor see.
A written table cuts lineage, survives the loss of any executor and keeps its
columns prunable.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where it is unset, a temporary one for a session in one process."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(sc, "_graphloom_shared", None)
        if folder is None:
            folder = "file://" + tempfile.mkdtemp(prefix="graphloom-")
            sc._graphloom_shared = folder
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def _found(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def exists(spark: SparkSession, path: str) -> bool:
    store, hadoop = _found(spark, path)
    return store.exists(hadoop)


def stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table, which change with it."""
    store, hadoop = _found(spark, path)
    if not store.exists(hadoop):
        return ()
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in store.listStatus(hadoop)))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and return a scan of what was written."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
