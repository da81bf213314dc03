"""Indexes: identity, incremental builds, drift, inventory, storage.

An index is three tables keyed by index_name: header, file (file, digest) and chunk (file, pos, ordinal, text, heading,
lines, vector, norm). Files without chunks stay in the file table, so that they are not reported as added for ever.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import doubles, norm
from ..session import scratch, ship
from ..sources import commit, ordered
from ..verdicts import Refused
from . import budget, calls, chunking

FORMAT = 2


def check_name(name: str) -> str:
    if not re.fullmatch(r"[a-z0-9_-]+", name or ""):
        raise Refused("invalid_request", f"index name {name!r} may hold a-z, 0-9, _ and - only", "choose another name")
    return name


def digests(corpus: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    return corpus.withColumn("digest", T.digest(F.col(text)))


def path_order(file: str = "file"):
    """Files in the order of their path components."""
    return F.split(F.col(file), "/")


def generation(files: DataFrame, *, model: str, doc_prefix: str = "", query_prefix: str = "", chunk_chars: int = chunking.TARGET, by: tuple[str, ...] = ()) -> DataFrame:
    """generation, file_count of files(file, digest), for each value of `by`: a hash over settings and files in order.

    The cluster sorts the files into parts and writes them; then one task for each index, or for the small indexes of a
    part, reads the finished parts in order and hashes row by row.
    """
    spark = files.sparkSession
    head = "".join(f"{x}\0" for x in (FORMAT, model, doc_prefix, query_prefix, chunk_chars)).encode()
    rows = files.select(*by, "file", "digest")
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*by).schema) + "generation string, file_count long"
    written = ordered.parts(rows, *by, path_order(), F.col("file"))

    def run(batches, only, but):
        key, hashed, count = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([v], k) for v, k in zip(key, kinds, strict=True)), pa.array([hashed.hexdigest()[:12]], pa.string()), pa.array([count], pa.int64())], [*by, "generation", "file_count"])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            values = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * batch.num_rows
            for group, file, digest in zip(values, batch.column("file").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                if group != key:
                    if hashed:
                        yield row()
                    name = [None if v is None else str(v) for v in group]
                    key, count = group, 0
                    hashed = hashlib.sha256(head) if (only is None or only == name) and name not in but else None
                if hashed:
                    hashed.update(f"{file}\0{digest}\0".encode())
                    count += 1
        if hashed:
            yield row()

    return ordered.stream(spark, ordered.groups(spark, written, by), run, schema)


def ordinals(chunks: DataFrame, by: tuple[str, ...] = (), counted: DataFrame | None = None) -> DataFrame:
    """Adds ordinal, from 0 over files in path order and chunks in theirs.

    The cluster sorts the files into parts by range; sums run inside a part, and over the parts' totals, which are as few
    as the parts. Chunks add their own position to the file's offset.
    counted: the same rows without what is dear to compute, from which the files' chunks are counted.
    """
    spark = chunks.sparkSession
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = (chunks if counted is None else counted).groupBy(*by, "file").agg(F.count("*").alias("_n"))
    path = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    files.repartitionByRange(number, *by, path_order(), F.col("file")).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    files = spark.read.parquet(path)
    totals = files.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_first", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*by, "_part").orderBy(path_order(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(totals, [*by, "_part"])
    files = files.select(*by, "file", (F.col("_first") + F.col("_inside")).alias("_before"))
    return chunks.join(files, [*by, "file"]).withColumn("ordinal", F.col("_before") + F.col("pos")).drop("_before")


def reuse(current: DataFrame, prior: DataFrame) -> DataFrame:
    """file, digest, action: reuse where the prior index holds the file with the same digest, else embed."""
    old = prior.select("file", "digest").distinct().withColumn("_old", F.lit(True))
    return current.select("file", "digest").join(old, ["file", "digest"], "left").select("file", "digest", F.when(F.col("_old"), "reuse").otherwise("embed").alias("action"))


def same_settings(header: DataFrame, *, model: str, chunk_chars: int, doc_prefix: str, query_prefix: str) -> bool:
    """Whether a prior header allows reuse: format, model, chunk size and prefixes as now."""
    want = {"format": FORMAT, "model": model, "chunk_chars": chunk_chars, "doc_prefix": doc_prefix, "query_prefix": query_prefix}
    got = header.select(*want).limit(2).collect()
    return len(got) == 1 and got[0].asDict() == want


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """file, status (added, removed, changed, same) from stored and current (file, digest)."""
    s = stored.select("file", F.col("digest").alias("_s"))
    c = current.select("file", F.col("digest").alias("_c"))
    status = F.when(F.col("_s").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_s") != F.col("_c"), "changed").otherwise("same")
    return s.join(c, "file", "full").select("file", status.alias("status"))


def drift_summary(rows: DataFrame, names: int = 20) -> DataFrame:
    """status, files, and the first names of each class that is not the same.

    Names are cut to the first ones in each task before they meet.
    """
    counts = rows.groupBy("status").agg(F.count("*").alias("files"))
    first = rows.where("status != 'same'").withColumn("_k", F.row_number().over(W.partitionBy("status").orderBy(path_order(), "file"))).where(F.col("_k") <= names)
    listed = first.groupBy("status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "file"))), lambda x: x["file"]), ",").alias("names"))
    return counts.join(listed, "status", "left").select("status", "files", F.coalesce("names", F.lit("")).alias("names"))


def drift_exit(reachable: bool, summary: DataFrame) -> int:
    """0 in step, 1 drifted, 2 cannot check: three answers that stay three."""
    if not reachable:
        return 2
    return int(bool(summary.where("status != 'same' AND files > 0").limit(1).count()))


def inventory(headers: DataFrame) -> DataFrame:
    """Listing of indexes, unreadable ones included, with unknown where a header field is missing."""
    known = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias(c) for c in ("description", "built_at", "model")]
    verdict = F.when(F.col("corrupt"), "index_unreadable").when(F.col("format").isNull() | (F.col("format") != FORMAT), "unsupported_index").otherwise("ok")
    return headers.select("name", *known, F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"), F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"), verdict.alias("verdict"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """inventory() of all indexes stored below a folder, by name; one that cannot be read is a row that says so."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        raise Refused("not_configured", f"no folder {path}", "build an index there")
    names = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.isDirectory())
    rows = []
    for name in names:  # one small header each
        try:
            h = read(spark, path, name)["header"].first()
            rows.append((name, False, h["format"], h["description"], h["built_at"], h["model"], h["file_count"], h["chunk_count"]))
        except Refused as e:
            rows.append((name, e.verdict != "unsupported_index", None, None, None, None, None, None))
        except Exception:  # noqa: BLE001 - whatever a damaged table raises, the index is unreadable
            rows.append((name, True, None, None, None, None, None, None))
    return inventory(spark.createDataFrame(rows, "name string, corrupt boolean, format int, description string, built_at string, model string, file_count long, chunk_count long")).orderBy("name")


def build(spark: SparkSession, corpus: DataFrame, name: str, embed, *, model: str, limit: int | None = None, details: DataFrame | None = None, target: int = chunking.TARGET, path: str | None = None, force: bool = False, description: str = "", root: str = "", batch: int = 16, log: str | None = None) -> dict[str, DataFrame]:
    """Builds an index of corpus(file, text), reusing the vectors of files that have not changed, and writes it.

    embed(texts) -> vectors is called on the workers in batches of `batch`. An embedder that has a name must be the
    model. limit is the model's context in tokens; where it is not given, it is that of the model in `details` (name,
    model_info, parameters), and an unknown one is refused. With `path`, the tables are written below it and a prior
    index there is used; without, chunks with their vectors are written to a scratch folder, so that no vector is
    computed twice. With `log`, a folder, every vector is logged as it arrives: a build that failed, started again,
    embeds only what is not logged. Of two builds that started from one version the second to end is refused.
    """
    check_name(name)
    if getattr(embed, "name", model) != model:
        raise Refused("model_not_found", f"the embedder is {embed.name!r}, not {model!r}", "name the index's model as the embedder's")
    if limit is None and details is not None:
        found = budget.limits(details.where(F.col("name") == model)).select("limit").first()
        limit = found and found[0]
    if limit is None:
        raise Refused("context_unknown", f"the context limit of {model} is not known", "pass limit")
    size = chunking.check_size(min(target, int(limit * T.CHARS_PER_TOKEN)))
    doc_prefix, query_prefix = T.prefixes_for(model)
    files = digests(corpus.select("file", "text"))
    if not files.limit(1).count():
        raise Refused("invalid_request", "the corpus holds no documents", "check the folder")
    prior, version = None, 0
    if path:
        version, held = commit.latest(spark, f"{path}/{name}")
        if held and not force:
            prior = _tables(spark, path, name, held)
        if prior and not same_settings(prior["header"], model=model, chunk_chars=size, doc_prefix=doc_prefix, query_prefix=query_prefix):
            prior = None
    todo, kept = files, None
    if prior:
        old = prior["file"].select("file", "digest")
        todo = files.join(old, ["file", "digest"], "left_anti")
        kept = prior["chunk"].join(files.select("file", "digest").join(old, ["file", "digest"], "left_semi"), "file").select("file", "pos", "text", "heading", "line_start", "line_end", "vector", "norm")
    plain = chunking.chunked(todo, size)
    fresh = calls.embedded(plain, embed, log, model=model, prefix=doc_prefix, batch=batch) if log else embedded(plain, embed, doc_prefix, batch)
    waiting = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"  # texts are cut and embedded once: files are counted from what is written
    fresh.write.parquet(waiting)
    fresh = spark.read.schema(fresh.schema).parquet(waiting)
    if kept is not None:
        fresh = fresh.unionByName(kept)
    chunk = ordinals(fresh)
    if path:  # every text is embedded once: what follows reads the stored rows
        build_id = uuid.uuid4().hex[:12]
        chunk.write.parquet(f"{path}/{name}/{build_id}/chunk")
        chunk = spark.read.parquet(f"{path}/{name}/{build_id}/chunk")
    else:
        stored = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
        chunk.write.parquet(stored)
        chunk = spark.read.parquet(stored)
    file = files.select("file", "digest")
    made = generation(file, model=model, doc_prefix=doc_prefix, query_prefix=query_prefix, chunk_chars=size)
    counts = chunk.agg(F.count("*").alias("chunk_count"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimensions"))
    header = made.join(F.broadcast(counts)).select(
        F.lit(name).alias("name"), F.lit(FORMAT).alias("format"), F.lit(description).alias("description"), F.lit(root).alias("source_root"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("built_at"), "generation", F.lit(model).alias("model"),
        F.lit(doc_prefix).alias("doc_prefix"), F.lit(query_prefix).alias("query_prefix"), F.lit(size).alias("chunk_chars"), "dimensions", "file_count", "chunk_count",
    )
    if path:
        return publish(header, file, chunk, path, name, build_id, version)
    return {"header": header, "file": file, "chunk": chunk}


def embedded(chunks: DataFrame, embed, prefix: str = "", batch: int = 16) -> DataFrame:
    """Adds vector and norm; embed gets the texts with the prefix, the stored text stays without."""
    ship(chunks.sparkSession)
    names = chunks.columns

    def run(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                some = rows.slice(at, batch)
                texts = [prefix + (t or "") for t in some.column("text").to_pylist()]
                vectors = embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(vectors, pa.list_(pa.float64()))], [*names, "vector"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema) + ", vector array<double>"
    return chunks.mapInArrow(run, schema).withColumn("norm", norm(F.col("vector")))


def embedded_checked(texts: DataFrame, embed, limit: int | None, *, key: str = "id", text: str = "text", allow_truncation: bool = False) -> DataFrame:
    """key, estimate, verdict, vector of texts(key, text): inputs over the whole limit are refused one by one, before any call.

    A null text is an invalid request, an unknown limit is context_unknown unless truncation is allowed, and an empty
    vector is a bad response, never a zero vector.
    """
    rows = texts.select(F.col(key), F.col(text).alias("text")).withColumn("estimate", T.tokens(F.length(F.coalesce("text", F.lit("")))))
    known = F.lit(limit).cast("bigint")
    over = F.lit(False) if allow_truncation else F.coalesce(F.col("estimate") > known, F.lit(False))
    unknown = F.lit(limit is None and not allow_truncation)
    verdict = F.when(T.blank("text"), "invalid_request").when(unknown, "context_unknown").when(over, "context_exceeded").otherwise("ok")
    rows = rows.withColumn("verdict", verdict)
    sent = embedded(rows.where("verdict = 'ok'"), embed).drop("norm", "text")
    sent = sent.withColumn("verdict", F.when(F.size("vector") > 0, "ok").otherwise("bad_response"))
    return sent.unionByName(rows.where("verdict != 'ok'").drop("text").withColumn("vector", F.lit(None).cast("array<double>")))


def publish(header: DataFrame, file: DataFrame, chunk: DataFrame, path: str, name: str, build_id: str, version: int) -> dict[str, DataFrame]:
    """Writes what is missing of a build into its own folder and publishes it last, as the version after the one it started from.

    Readers of the old build are not disturbed, and a build that reuses old rows may read them while it writes.
    """
    spark = header.sparkSession
    out = {"chunk": chunk}
    for kind, df in (("file", file), ("header", header)):
        df.write.parquet(f"{path}/{name}/{build_id}/{kind}")
        out[kind] = spark.read.parquet(f"{path}/{name}/{build_id}/{kind}")
    commit.publish(spark, f"{path}/{name}", version + 1, {"build": build_id})
    return out


def _tables(spark: SparkSession, path: str, name: str, held: dict) -> dict[str, DataFrame]:
    return {kind: spark.read.parquet(f"{path}/{name}/{held['build']}/{kind}") for kind in ("header", "file", "chunk")}


def read(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """The tables of the last version published."""
    check_name(name)
    version, held = commit.latest(spark, f"{path}/{name}")
    if held is None:
        raise Refused("index_not_found", f"no index {name}", "list the indexes")
    try:
        tables = _tables(spark, path, name, held)
        found = tables["header"].select("format").first()
    except Exception as e:
        if isinstance(e, Refused):
            raise
        raise Refused("index_unreadable", f"version {version} of {name}: {type(e).__name__}", "build it again") from e
    if found is None or found[0] != FORMAT:
        raise Refused("unsupported_index", f"index {name} has format {found and found[0]}", "build it again")
    return tables


def retain(spark: SparkSession, path: str, name: str, last: int = 2) -> int:
    """Drops all builds but those of the last versions; returns how many. A reader that still reads a dropped one fails."""
    gone = commit.keep(spark, f"{path}/{name}", last)
    for held in gone:
        files, folder = commit.files_of(spark, f"{path}/{name}/{held['build']}")
        files.delete(folder, True)
    return len(gone)


def invariants(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the header's promises held against the tables."""
    f = tables["file"].agg(F.count("*").alias("files"))
    c = tables["chunk"].agg(F.count("*").alias("chunks"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("size"))
    h = tables["header"].select("file_count", "chunk_count", "dimensions")
    return h.join(F.broadcast(f)).join(F.broadcast(c)).select((F.col("file_count") == F.col("files")).alias("files_ok"), (F.col("chunk_count") == F.col("chunks")).alias("chunks_ok"), (F.col("dimensions") == F.col("size")).alias("dimensions_ok"))


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """A table of vectors as chunks: double vectors with their norms, computed once."""
    return embeddings.withColumn("vector", doubles(F.col("embedding"))).withColumn("norm", norm(F.col("vector")))
