"""What the operators of this subpackage share: tables, scratch tables in the shared folder, packed rows.

A packed row carries whole numpy arrays in binary columns. Exchanging a few thousand packed rows instead of
millions of small ones keeps the shuffle small; groups are sized by a bucket count that follows the input's partitions.
"""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

_made: list[str] = []
_stale: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows, so that a batch of long texts stays small; workers get the package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


@functools.cache
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="spindrift-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _delete(paths: list[str]) -> None:
    from pyspark import SparkContext

    jvm = SparkContext._jvm
    if jvm is None:
        return
    conf = jvm.org.apache.hadoop.conf.Configuration() if SparkContext._active_spark_context is None else SparkContext._active_spark_context._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


@functools.cache
def _sweep_at_exit() -> None:
    """Scratch tables that a result may still read stay until this process ends."""

    def sweep():
        try:
            _delete(_made)
        except Exception:  # noqa: BLE001, S110 - the JVM may be gone; nothing is left to tell
            pass

    atexit.register(sweep)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one. Where the session names none, a local folder, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors cannot read each other's local folders")
        base = _local_folder()
    _sweep_at_exit()
    path = f"{base.rstrip('/')}/spindrift-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: later steps start there, not at the input."""
    spark = df.sparkSession
    path = shared_folder(spark)
    (df.coalesce(parts) if parts else df).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes materialised tables that no later step reads."""
    for df in tables:
        paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        gone = [p for p in _made if any(q.endswith(p.split("://")[-1]) for q in paths)]
        _delete(gone)
        for p in gone:
            _made.remove(p)


def trim(spark: SparkSession) -> None:
    """Lets the driver give back what planning and tracking its last jobs took: between collections of the whole heap it only grows."""
    spark.sparkContext._jvm.System.gc()


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps."""
    import gc
    import time

    for _ in range(2):  # what the first finds unreachable lets go of more
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def stage(function):
    """A pipeline stage: when it starts, the scratch tables of the stage before, whose rows are written by then, go."""

    @functools.wraps(function)
    def run(spark, docs, sf_dir):
        _delete(_stale)
        _made[:] = [p for p in _made if p not in _stale]
        _stale.clear()
        collect_garbage(spark)
        before = len(_made)
        out = function(spark, docs, sf_dir)
        _stale.extend(_made[before:])
        return out

    return run


def parts_of(df: DataFrame) -> int:
    """Partitions of an input that is a plain scan, which follow its size, and at least the session's number."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def groups_of(df: DataFrame, each: int = 1 << 22) -> int:
    """How many groups of about `each` bytes of its files the input makes, and at least its partitions.

    A group is held whole by a worker, so groups follow the input's bytes and not the number of tasks.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parts_of(df), -(-size // each) if size < 1 << 60 else 1)  # without statistics the size is a huge default


def joined(column, dtype) -> np.ndarray:
    """One array from the packed arrays of a binary Arrow column."""
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start, start+1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)
