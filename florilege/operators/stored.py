"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared").rstrip("/")


#: Tables that this process has stored.
_made: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage and outlives lost executors. It stays until clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/florilege/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete what stored() has written for this process, once the results that rest on it are written: how many tables went."""
    gone = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone


def qualified(spark: SparkSession, path: str) -> str:
    """path with its scheme: one without is on Spark's default file system, not on the machine that happens to open it."""
    given = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = given.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(given).toUri().toString()
    return re.sub("^file:/(?!/)", "file:///", uri)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, for tasks that read or write bytes, and the path in it; s3a and s3n are other names of s3."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
