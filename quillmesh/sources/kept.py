"""Tables that are worked out once for what a source holds now, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where it is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def version(spark: SparkSession, *paths: str) -> str:
    """What changes when one of the paths is written again: names, sizes and times."""
    told = []
    for path in paths:
        fs, p = _path(spark, path)
        summary = fs.getContentSummary(p)
        told.append((path, summary.getLength(), summary.getFileCount(), fs.getFileStatus(p).getModificationTime()))
    return hashlib.md5(repr(told).encode()).hexdigest()


def kept(spark: SparkSession, name: str, of: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table called name for version `of` of its sources: read if it was written whole, else made and written."""
    path = f"{shared(spark)}/kept-{name}-{of}"
    fs, p = _path(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
