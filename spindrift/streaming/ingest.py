"""A stream of documents merged into a table of current digests, batch by batch.

Each batch is compared with the table by file and digest; only what changed is written, as a part of its own, and the
table is all parts with the last row of each file. The parts of a version are named in a pointer that is published
atomically, so a reader sees whole batches, and a batch that is replayed after its version was published changes nothing.
After COMPACT parts they are written as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import commit

COMPACT = 16


def merge(current: DataFrame | None, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new table, changed rows) of a batch(file, text, seen); of several versions of a file the last seen counts."""
    last = batch.groupBy("file").agg(F.max_by(F.struct("text", "seen"), F.struct("seen", "text")).alias("r")).select("file", "r.text", "r.seen").withColumn("digest", T.digest("text"))
    if current is None:
        return last.select("file", "digest", "seen"), last
    old = current.select("file", F.col("digest").alias("_old"))
    changed = last.join(old, "file", "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("digest"))).drop("_old")
    kept = current.join(changed.select("file"), "file", "left_anti")
    return kept.unionByName(changed.select("file", "digest", "seen")), changed


def ingest(stream: DataFrame, path: str, checkpoint: str, on_change: Callable[[DataFrame, int], None] | None = None):
    """Starts the stream of (file, text, seen) into a table below `path`; returns the query.

    on_change gets the changed rows before the version is published, and again if the batch is replayed before that.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, held = commit.latest(spark, path)
        if held and held["batch"] >= number:
            return
        parts = list(held["parts"]) if held else []
        _, changed = merge(_table(spark, path, parts) if parts else None, batch)
        changed = changed.persist()
        name = f"b{number}-{uuid.uuid4().hex[:8]}"
        changed.select("file", "digest", "seen", F.lit(number).cast("long").alias("batch")).write.parquet(f"{path}/{name}")
        if on_change:
            on_change(changed, number)
        parts.append(name)
        if len(parts) > COMPACT:
            _rows(spark, path, parts).write.parquet(f"{path}/all-{name}")
            parts = [f"all-{name}"]
        commit.publish(spark, path, version + 1, {"batch": number, "parts": parts})
        changed.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _rows(spark, path: str, parts: list[str]) -> DataFrame:
    rows = spark.read.parquet(*(f"{path}/{p}" for p in parts))
    return rows.groupBy("file").agg(F.max_by(F.struct("digest", "seen", "batch"), "batch").alias("r")).select("file", "r.*")


def _table(spark, path: str, parts: list[str]) -> DataFrame:
    return _rows(spark, path, parts).drop("batch")


def current(spark, path: str) -> DataFrame | None:
    """The table as of the last batch that was published, or None before the first."""
    _, held = commit.latest(spark, path)
    return _table(spark, path, held["parts"]) if held else None
