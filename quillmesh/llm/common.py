"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that a Python worker gets; a longer text is a batch of its own.
BATCH_BYTES = 768 << 10
M64 = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, read by Spark alone (the path may be in any store Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, so that a batch of very long texts fits a Python worker. The same for all operators."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def trim() -> None:
    """Gives freed memory of this Python worker, which later tasks use too, back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def tidy(spark: SparkSession) -> None:
    """Gives memory that the driver is done with back to the machine; call it between steps of a long job.

    A JVM keeps the heap that its busiest moment took until a full collection, and Spark drops shuffles and broadcasts that nothing refers to after one.
    """
    trim()
    spark.sparkContext._jvm.java.lang.System.gc()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and after its last batch freed memory goes back: workers live on and serve other tasks."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return trimmed


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run in one process.

    A cluster without the setting is refused: its executors would not see a folder of the driver's machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="quillmesh-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session is gone, and its shared folder is the cluster's to clear
        pass


def stash(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back, so a lost executor costs a reread and not a recomputation.

    The files go when free() is called, at the latest when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_drop, spark, path)
    made = spark.read.schema(df.schema).parquet(path)
    made._stash = path
    return made


def bucketed(df: DataFrame, by: list[str]) -> DataFrame:
    """The same as a table in buckets by those columns, as many as shuffles have partitions: joins on them don't shuffle it again."""
    spark = df.sparkSession
    name = f"quillmesh_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/stash-{name}"
    df.write.format("parquet").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).saveAsTable(name)
    atexit.register(_drop, spark, path)
    made = spark.table(name)
    made._stash, made._table = path, name
    return made


def free(*tables: DataFrame) -> None:
    """Deletes tables that stash and bucketed wrote. Call it once all that reads them is written itself: what is lost later could not be made again."""
    for t in tables:
        if name := getattr(t, "_table", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        _drop(t.sparkSession, t._stash)


def placed(df: DataFrame) -> DataFrame:
    """df's columns as c0, c1 and so on, and the place (file, place) that tells each row from all others, equal ones included.

    The place is that in the files that df is read from; whatever else df is is written first.
    """
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not df.inputFiles():
        plain = stash(plain)
    return plain.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))


def numbered(df: DataFrame, by: list[str], order: list[str], parts: int = 64) -> DataFrame:
    """df with n, the number from 0 of each row among those with its values of by (none of them null). A hot key's rows are numbered in parts.

    The rows are read more than once: pass what gives the same ones each time.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    before = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_row", own).join(before, [*by, "_part"]).withColumn("n", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def few(df: DataFrame, bound: int, entries: str | None = None) -> DataFrame:
    """df marked for broadcast if it has no more rows than bound, entries of its array column included; else as it is, to be joined by a shuffle."""
    if entries is None:
        return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df
    rows, held = df.agg(F.count("*"), F.sum(F.size(entries))).first()
    return F.broadcast(df) if rows + (held or 0) <= bound else df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial fingerprints modulo 2**64 of any slices of a byte string, from one pass over it."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _up = powers(1 << 12, BASE)
    _down = powers(1 << 12, INVERSE)
    _letters = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if n >= len(Rolling._up):
            size = 1 << (n + 1).bit_length()
            Rolling._up, Rolling._down = powers(size, self.BASE), powers(size, self.INVERSE)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self._letters[data] * self._up[:n], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The fingerprint of each slice [start, end)."""
        return mix64((self.sums[end] - self.sums[start]) * self._down[start])

    def windows(self, k: int) -> np.ndarray:
        """The fingerprint of each slice of k bytes."""
        n = len(self.sums) - k
        return mix64((self.sums[k:] - self.sums[:-k]) * self._down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)
