"""A folder of markdown files as a corpus (file, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import newlines
from ..verdicts import Refused


def scan(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """file (relative, with /), text of every matching file below a folder, bad bytes replaced and line ends as LF.

    A byte order mark stays: it hides a heading, as it does for a reader in text mode. Empty files are rows too.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path) or not files.getFileStatus(path).isDirectory():
        raise Refused("invalid_request", f"{folder} is not a folder", "pass the corpus folder")
    root = files.getFileStatus(path).getPath().toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    bare = lambda c: F.regexp_replace(c, r"^[a-z0-9]+:/+", "/")
    start = F.length(bare(F.lit(root))) + 1
    text = newlines(F.make_valid_utf8(F.col("content").cast("string")))
    return rows.select(F.substr(bare(F.col("path")), start).alias("file"), F.coalesce(text, F.lit("")).alias("text"))


def empty_files(spark: SparkSession, folder: str, suffix: str = ".md") -> list[str]:
    """Names of files without a byte, which some readers give no row for."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root, out = files.getFileStatus(path).getPath().toString().rstrip("/") + "/", []
    found = files.listFiles(path, True)
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0 and f.getPath().getName().endswith(suffix):
            out.append(f.getPath().toString().removeprefix(root))
    return sorted(out, key=lambda x: x.split("/"))
