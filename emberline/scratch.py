"""Shared scratch tables: where lineage is cut, and where archives and models lie.

The folder is the one the cluster names in spark.checkpoint.dir, which driver
and executors share. Where that is unset, a local session (tests on one machine)
gets a temporary folder, set once; any other is refused, since executors would not
share it.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The URI of a new folder of this session's own; it goes when the interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="emberline-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/emberline-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; nothing happens where the session has ended."""
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The frame as a Parquet table in scratch, read again: its lineage ends there."""
    spark = df.sparkSession
    path, schema = path or f"{folder(spark)}/table", df.schema
    release(spark)  # what the caller still held during the last call
    df.write.mode("overwrite").parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver collects its garbage."""
    gc.collect()
    with contextlib.suppress(Exception):
        spark._jvm.System.gc()
