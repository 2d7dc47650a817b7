"""Checks of what the engine needs before it runs."""

from __future__ import annotations

import importlib.util
import os
import shutil
import uuid

from pyspark.sql import SparkSession

from quillmesh import runtime
from quillmesh import schema as S
from quillmesh.settings import local_endpoint
from quillmesh.sources.store import Store

Check = dict[str, str]


def _check(name: str, run) -> Check:
    try:
        status, message = run()
    except Exception as e:  # noqa: BLE001 - a check that fails is a finding
        status, message = "FAIL", f"{type(e).__name__}: {str(e)[:200]}"
    return {"name": name, "status": status, "message": message}


def examine(spark: SparkSession, root: str, dim: int = 64, endpoint: str = "", ports: tuple = ()) -> dict:
    """{exit_code, checks}: 0 if all is well, 1 with any failure, 2 with warnings only."""
    store = Store(spark, root)

    def folder():
        name = f"{root.rstrip('/')}/_probe-{uuid.uuid4().hex}"
        spark.range(3).write.parquet(name)
        n = spark.read.parquet(name).count()
        fs, p = store._fs(name)
        fs.delete(p, True)
        return ("OK", "tables can be written and read") if n == 3 else ("FAIL", "what was written is not what is read")

    def versions():
        seen = [r["notes"] for r in store.read("log").filter("action = 'bootstrap'").select("notes").distinct().collect()]
        newer = [v for v in seen if [int(x) for x in v.split(".")] > [int(x) for x in S.SCHEMA_VERSION.split(".")]]
        return ("FAIL", f"the store has schema {newer[0]}") if newer else ("OK", S.SCHEMA_VERSION) if seen else ("WARN", "no space is set up")

    def vectors():
        row = store.read("points").selectExpr("size(embedding) AS n").filter(f"n <> {dim}").first()
        return ("FAIL", f"stored vectors have {row['n']} numbers") if row else ("OK", f"{dim} numbers")

    def locking():
        with runtime.lock(spark, root, f"probe-{uuid.uuid4().hex}"):
            return "OK", "locks work"

    checks = [
        _check("spark", lambda: ("OK", spark.version)),
        _check("time_zone", lambda: ("OK", "UTC") if spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC") else ("WARN", "the session's time zone is not UTC")),
        _check("adaptive", lambda: ("OK", "on") if spark.conf.get("spark.sql.adaptive.enabled") == "true" else ("WARN", "adaptive execution is off")),
        _check("shared_folder", lambda: ("OK", "set") if spark.conf.get("spark.checkpoint.dir", None) else ("WARN" if spark.sparkContext.master.startswith("local") else "FAIL", "spark.checkpoint.dir is unset")),
        _check("store", folder),
        _check("schema", versions),
        _check("vectors", vectors),
        _check("locks", locking),
        _check("arrow", lambda: ("OK", "there") if importlib.util.find_spec("pyarrow") else ("FAIL", "pyarrow is missing")),
        _check("pdf_reader", lambda: ("OK", "there") if importlib.util.find_spec("pypdf") else ("WARN", "pypdf is missing: PDFs are refused")),
        _check("driver_disk", lambda: ("OK", "enough") if shutil.disk_usage(os.getcwd()).free > 1 << 30 else ("WARN", "under 1 GiB left")),
        _check("endpoint", lambda: ("OK", "local or none") if not endpoint or local_endpoint(endpoint) else ("WARN", "texts leave this machine")),
        _check("ports", lambda: ("OK", "80 and 443") if not ports else ("WARN", f"more ports may be asked: {ports}")),
    ]
    found = {c["status"] for c in checks}
    return {"exit_code": 1 if "FAIL" in found else 2 if "WARN" in found else 0, "checks": checks}
