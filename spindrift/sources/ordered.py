"""Rows in an order that holds across files: sorted by the cluster into parts, and read part after part by one task.

For what is sequential by definition, such as a hash over all rows or one document: the sorting is done before, by as
many tasks as there are parts, and the task that reads holds one batch.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship
from .commit import files_of


def parts(rows: DataFrame, *order: Column | str, path: str | None = None) -> list[str]:
    """Writes the rows sorted by `order`, a range of it to each part; returns the parts' files in order."""
    spark = rows.sparkSession
    path = path or f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(number, *order).sortWithinPartitions(*order).write.parquet(path)
    files, folder = files_of(spark, path)
    names = (str(f.getPath().toString()) for f in files.listStatus(folder))
    return sorted((n for n in names if n.rsplit("/", 1)[1].startswith("part-")), key=lambda n: n.rsplit("/", 1)[1])


def store_of(uri: str):
    """pyarrow's file system and path of a Hadoop path."""
    from pyarrow import fs

    if re.match(r"[a-z0-9]+:/", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def batches_of(files: list[str], rows: int = 1 << 13):
    from pyarrow import parquet

    for f in files:
        store, path = store_of(f)
        with store.open_input_file(path) as stream:
            yield from parquet.ParquetFile(stream).iter_batches(batch_size=rows)


def stream(spark: SparkSession, tasks: list[tuple], run, schema: str) -> DataFrame:
    """run(batches of the files, *rest) for each (files, *rest), a task each."""
    import json

    ship(spark)
    todo = spark.createDataFrame([(k, json.dumps(t)) for k, t in enumerate(tasks)], "k long, task string").repartition(max(1, len(tasks)), "k")

    def go(batches):
        for batch in batches:
            for task in batch.column("task").to_pylist():
                files, *rest = json.loads(task)
                yield from run(batches_of(files), *rest)

    return todo.mapInArrow(go, schema)


def groups(spark: SparkSession, files: list[str], by: tuple[str, ...]) -> list[tuple[list[str], list | None, list]]:
    """Tasks (files, only, but) over parts sorted by `by` first, so that each group is in one task whole.

    A group that several parts hold is a task of its own, over these parts; each part is a task for its other groups.
    """
    if not by:
        return [(files, None, [])]
    key = F.struct(*(F.col(c).cast("string").alias(c) for c in by))
    found = spark.read.parquet(*files).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f"), key.alias("k"), F.struct(*by).alias("s"))
    ends = {r.f: (list(r.a), list(r.b)) for r in found.groupBy("f").agg(F.min_by("k", "s").alias("a"), F.max_by("k", "s").alias("b")).collect()}  # two keys a part
    spans: dict[str, tuple[list, list[str]]] = {}
    for f in files:
        for k in ends.get(f.rsplit("/", 1)[1], ()):
            held = spans.setdefault(str(k), (k, []))[1]
            if f not in held:
                held.append(f)
    several = {s: v for s, v in spans.items() if len(v[1]) > 1}
    whole = [(fs, k, []) for k, fs in several.values()]
    return whole + [([f], None, [k for k, fs in several.values() if f in fs]) for f in files if f.rsplit("/", 1)[1] in ends]
