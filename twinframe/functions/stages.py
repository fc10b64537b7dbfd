"""Stages written to the folder that driver and executors share, so that later jobs recompute nothing above them."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and all runs on this machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN_DIR.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="twinframe-shared-"))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/twinframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the store that holds `path`."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def count_files(spark: SparkSession, path: str) -> int:
    """Data files in a folder."""
    fs, at = hadoop_path(spark, path)
    return sum(f.isFile() and not f.getPath().getName().startswith(("_", ".")) for f in fs.listStatus(at))


def remove(spark: SparkSession, path: str) -> None:
    """Delete what nothing reads any more."""
    fs, at = hadoop_path(spark, path)
    fs.delete(at, True)


def same(a: str, b: str, columns) -> Column:
    """All columns of the aliases `a` and `b` agree; null agrees with null."""
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns], F.lit(True))
