"""The Spark session, and shipping this package to Python workers."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}
_shipped: weakref.WeakSet = weakref.WeakSet()


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("spindrift").config(map=CONF | conf)
    return (builder.master(master) if master else builder).getOrCreate()


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="spindrift-scratch-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch(spark: SparkSession) -> str:
    """The folder for tables between steps: the cluster's shared one; a local folder, on a local master only, where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/spindrift-index"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors cannot read each other's local folders")
    return _local_folder()


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once per context, so that they need no path of ours."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spindrift-")
    with zipfile.ZipFile(name := os.path.join(folder, "spindrift-package.zip"), "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    _shipped.add(sc)
