"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's folder. A local session without one gets a folder of its own; a cluster without
    one is refused, as no folder of one machine serves it."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(tempfile.gettempdir(), "plumbline-checkpoints")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def _file(spark: SparkSession, path: str) -> tuple:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a file or folder; whether there was one."""
    fs, target = _file(spark, path)
    return fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file(spark, path)
    return fs.exists(target)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no folder."""
    fs, target = _file(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def move(spark: SparkSession, path: str, to: str) -> None:
    """Renames a file or folder in one step."""
    fs, source = _file(spark, path)
    target = _file(spark, to)[1]
    if not fs.mkdirs(target.getParent()) or not fs.rename(source, target):
        raise OSError(f"{path} can't be moved to {to}")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is still there when the session ends goes then."""
    path = f"{shared_dir(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    fs, target = _file(spark, path)
    fs.deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it back: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

