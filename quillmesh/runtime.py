"""One writer at a time, retries and timing spans."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time
from collections.abc import Callable, Iterator
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
#: What turns timing off, and what sends it to the error stream instead of a file.
OFF, STREAM = ("", "0", "false", "no", "off"), ("1", "true", "yes", "on")


class Busy(Exception):
    """Another writer holds the lock."""


@contextlib.contextmanager
def lock(spark: SparkSession, root: str, name: str, stale: float = 6 * 3600) -> Iterator[None]:
    """Holds the lock `name` under root, by a file that only one writer can create in whatever store root is in; a lock older than `stale` seconds is taken over. Raises Busy rather than wait."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_locks/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path) and time.time() * 1000 - fs.getFileStatus(path).getModificationTime() > stale * 1000:
        fs.delete(path, False)
    try:
        made = fs.createNewFile(path)
    except Exception as e:  # noqa: BLE001 - stores tell of an existing file in their own ways
        raise Busy(name) from e
    if not made:
        raise Busy(name)
    try:
        yield
    finally:
        fs.delete(path, False)


def only_one(spark: SparkSession, root: str, name: str, run: Callable[[], T]) -> T | dict:
    """run's result, or {"status": "skipped"} if another holds the lock: skip, not wait."""
    try:
        with lock(spark, root, name):
            return run()
    except Busy:
        return {"status": "skipped", "reason": f"{name} is running"}


def retried(spark: SparkSession, root: str, name: str, run: Callable[[], T], attempts: int = 5, delay: float = 1.0) -> T:
    """run's result under the lock, tried so often with a pause in between; Busy after the last."""
    for turn in range(attempts):
        try:
            with lock(spark, root, name):
                return run()
        except Busy:
            if turn + 1 == attempts:
                raise
            time.sleep(delay)
    raise Busy(name)


def target(value: str | None = None) -> str | None:
    """Where spans go by QUILLMESH_PROFILE: nowhere, `stderr` or a file."""
    raw = (os.environ.get("QUILLMESH_PROFILE", "") if value is None else value).strip()
    return None if raw.lower() in OFF else "stderr" if raw.lower() in STREAM else raw


def event(name: str, seconds: float | None = None, **meta) -> None:
    """A JSON line with what happened; telling it never fails what it tells of."""
    where = target()
    if where is None:
        return
    line = json.dumps({"span": name, "seconds": seconds, **meta}, default=str)
    with contextlib.suppress(OSError):
        if where == "stderr":
            print(f"[profile] {line}", file=sys.stderr, flush=True)
        else:
            with open(where, "a", encoding="utf-8") as f:
                f.write(line + "\n")


@contextlib.contextmanager
def span(name: str, **meta) -> Iterator[dict]:
    """Times the block; what it adds to the dict it is given goes with the line."""
    began = time.monotonic()
    try:
        yield meta
    finally:
        event(name, round(time.monotonic() - began, 3), **meta)
