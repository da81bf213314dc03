"""Versions of a table or index, published atomically: numbered pointer files, each made exclusively, of which the last holds.

A pointer is written whole under another name and then takes its number, which fails where the number is taken: a reader
sees an old version or a new one, never a part, and of two writers that started from one version the second is told.
Pointers are a few bytes; what they point to is written before them, under names of its own. The store's rename must refuse
a name that is taken, as HDFS does; on local disks a hard link is made instead.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import SparkSession

from ..verdicts import Refused

FOLDER = "_versions"  # readers of the data beside it pass by names with an underscore


def files_of(spark: SparkSession, path: str):
    """Hadoop's FileSystem and Path of a path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, in order."""
    files, folder = files_of(spark, f"{path}/{FOLDER}")
    if not files.exists(folder):
        return []
    names = (f.getPath().getName() for f in files.listStatus(folder))
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d{10}", n))


def load(spark: SparkSession, path: str, number: int) -> dict:
    """What a version says."""
    files, where = files_of(spark, f"{path}/{FOLDER}/v{number:010d}")
    stream = files.open(where)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def latest(spark: SparkSession, path: str) -> tuple[int, dict | None]:
    """(number, content) of the last version; (0, None) before the first. A version dropped meanwhile is passed by."""
    for number in reversed(versions(spark, path)):
        try:
            return number, load(spark, path, number)
        except Exception as e:  # noqa: BLE001 - Java's exceptions arrive wrapped
            if "FileNotFoundException" not in str(e):
                raise
            return latest(spark, path)
    return 0, None


def publish(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """Makes version `number`, which must be new: else index_error, and nothing has changed."""
    jvm = spark.sparkContext._jvm
    files, folder = files_of(spark, f"{path}/{FOLDER}")
    files.mkdirs(folder)
    written = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    stream = files.create(written, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    target = jvm.org.apache.hadoop.fs.Path(folder, f"v{number:010d}")
    if files.getScheme() == "file":  # a local rename replaces what is there; a hard link does not
        nio = jvm.java.nio.file
        local = lambda p: nio.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
        try:
            nio.Files.createLink(local(target), local(written))
            done = True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExistsException" not in str(e):
                raise
            done = False
        files.delete(written, False)
    else:
        done = files.rename(written, target)
        if not done:
            files.delete(written, False)
    if not done:
        raise Refused("index_error", f"version {number} of {path} was published meanwhile", "start again from the new version")


def keep(spark: SparkSession, path: str, last: int) -> list[dict]:
    """Drops all but the last versions' pointers; returns what the dropped ones said, for the caller to delete."""
    gone = []
    for number in versions(spark, path)[:-last]:
        gone.append(load(spark, path, number))
        files, where = files_of(spark, f"{path}/{FOLDER}/v{number:010d}")
        files.delete(where, False)
    return gone
