"""Index documents of format 2: one JSON object with settings, and files that hold chunks; read and written as a stream.

A document may be larger than a worker's memory. It is read by blocks, value by value: what is held is a block and one
chunk (or one file's chunks, where a file's name stands behind them). A document is judged before any of its rows is
handed on, so it is read twice. It is written in pieces by the cluster, each a range of files, which one task joins.
"""

from __future__ import annotations

import codecs
import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, ship
from . import ordered
from .commit import files_of

FORMAT = 2
ROWS = 256  # made Python's at a time
TEXTS = ("name", "description", "source_root", "built_at", "builder_version", "generation", "model", "doc_prefix", "query_prefix")
NUMBERS = ("format", "chunk_chars", "dimensions", "file_count", "chunk_count")
HEADER = ", ".join(f"{c} string" for c in TEXTS) + ", " + ", ".join(f"{c} long" for c in NUMBERS)
CHUNK = "document string, file string, digest string, pos long, text string, heading string, line_start long, line_end long, vector array<double>"
BEGINS = re.compile(rb'\{\s*"(?:file|digest|chunks)"\s*:')
_decode = json.JSONDecoder().raw_decode


class Values:
    """The values of a JSON text that arrives in blocks. Malformed or cut text raises ValueError."""

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.text, self.at, self.ended = stream, block, "", 0, False
        self.bytes = codecs.getincrementaldecoder("utf-8")()
        self.before, self.places = 0, {}

    def more(self, size: int) -> bool:
        if self.ended:
            return False
        if (at := getattr(self.stream, "at", None)) in getattr(self.stream, "stops", ()):
            self.places[self.before + len(self.text)] = at
        data = self.stream.read(size)
        self.ended = not data
        self.before += self.at
        self.text, self.at = self.text[self.at :] + self.bytes.decode(data, final=self.ended), 0
        return True

    def next(self) -> str:
        """The next character that is not white space, which stays; empty at the end."""
        while True:
            while self.at < len(self.text):
                if self.text[self.at] not in " \t\r\n":
                    return self.text[self.at]
                self.at += 1
            if not self.more(self.block):
                return ""

    def place(self) -> int | None:
        """The stop of the stream at which the next character stands, if it is one."""
        self.next()
        return self.places.get(self.before + self.at)

    def take(self, *wanted: str) -> str:
        found = self.next()
        if found not in wanted or not found:
            raise ValueError(f"{found!r} where {' or '.join(wanted)} belongs")
        self.at += 1
        return found

    def value(self):
        """A whole value, for which as much is read as it takes, twice as much at each try."""
        self.next()
        size = self.block
        while True:
            try:
                found, end = _decode(self.text, self.at)
            except ValueError:
                if self.ended:
                    raise
            else:
                rest = self.text[end : end + 64]
                if self.ended or rest and (rest[0] not in ".eE+-0123456789" or len(rest) == 64):  # a number at the end of a block may go on
                    self.at = end
                    return found
            self.more(size)
            size *= 2

    def keys(self, inside: bool = False) -> Iterator[str]:
        """The keys of an object, or with `inside` those behind a value of it; the caller takes each one's value."""
        if not inside:
            self.take("{")
            if self.next() == "}":
                self.at += 1
                return
        elif self.take(",", "}") == "}":
            return
        while True:
            if self.next() != '"':
                raise ValueError("a key is no text")
            key = self.value()
            self.take(":")
            yield key
            if self.take(",", "}") == "}":
                return

    def items(self, inside: bool = False) -> Iterator[None]:
        """Stops before each element of an array, or with `inside` of one that was begun; the caller takes it."""
        if not inside:
            self.take("[")
            if self.next() == "]":
                self.at += 1
                return
        while True:
            yield
            if self.take(",", "]") == "]":
                return


class Part:
    """A file's bytes from a place on, in blocks none of which goes over one of the stops."""

    def __init__(self, file, at: int, stops: list[int]):
        file.seek(at)
        self.file, self.at, self.stops, self.next = file, at, set(stops), sorted(stops, reverse=True)

    def read(self, size: int) -> bytes:
        while self.next and self.next[-1] <= self.at:
            self.next.pop()
        data = self.file.read(min(size, self.next[-1] - self.at) if self.next else size)
        self.at += len(data)
        return data


def events(stream, block: int = 1 << 20, inside: bool = False) -> Iterator[tuple]:
    """("field", key, value) for each setting and ("chunk", file, digest, pos, chunk) for each chunk, in the document's order.

    With `inside` the stream begins at one of the files. Where a file begins at one of the stops of a Part, ("next", stop) is the last event.
    """
    values = Values(stream, block)

    def files(begun):
        for _ in values.items(begun):
            if (stop := values.place()) is not None:
                yield "next", stop
                return True
            names, held, pos = {}, [], 0
            for name in values.keys():
                if name != "chunks" or values.next() != "[":
                    names[name] = values.value()
                else:
                    for _ in values.items():
                        held.append((pos, values.value()))
                        pos += 1
                        if "file" in names and "digest" in names:
                            yield from (("chunk", names["file"], names["digest"], *h) for h in held)
                            held.clear()
                if "file" in names and "digest" in names:
                    yield from (("chunk", names["file"], names["digest"], *h) for h in held)
                    held.clear()
            yield from (("chunk", names.get("file"), names.get("digest"), *h) for h in held)
        return False

    if inside and (yield from files(True)):
        return
    for key in values.keys(inside):
        if key != "files" or values.next() != "[":
            yield "field", key, values.value()
        elif (yield from files(False)):
            return
    if values.next():
        raise ValueError("text behind the document")


def _text(x) -> str | None:
    return x if x is None or isinstance(x, str) else json.dumps(x)


def _whole(x) -> int | None:
    return x if isinstance(x, int) and not isinstance(x, bool) else None


def _paths(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path", "length")  # names and sizes: the content is not read
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def _starts(paths: DataFrame, span: int) -> DataFrame:
    """path, length, start, stops: where a document may be cut: at 0 and, of each span, where a file seems to begin first; and all later ones."""

    def run(batches):
        for batch in batches:
            found = []
            for path, begin, end in zip(*(batch.column(c).to_pylist() for c in ("path", "begin", "end")), strict=True):
                store, where = ordered.store_of(path)
                start, held, at = None if begin else 0, b"", begin
                with store.open_input_file(where) as file:
                    file.seek(begin)
                    while start is None and at < end and (data := file.read(min(1 << 20, end - at))):
                        held, at = held[-64:] + data, at + len(data)
                        if m := BEGINS.search(held):
                            start = at - len(held) + m.start()
                found.append(start)
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.int64())], ["path", "length", "start"])

    number = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = F.greatest(F.lit(span), F.ceil(F.col("length") / 1000)).cast("long")  # some thousand cuts at most
    spans = paths.select("path", "length", size.alias("size")).select("*", F.explode(F.expr("sequence(0L, greatest(length - 1, 0L), size)")).alias("begin"))
    spans = spans.select("path", "length", "begin", (F.col("begin") + F.col("size")).alias("end")).repartition(number, "path", "begin")
    found = spans.mapInArrow(run, "path string, length long, start long").groupBy("path", "length").agg(F.array_sort(F.collect_set("start")).alias("starts"))
    return _cut(found.select("path", "length", "starts"), "starts", number)


def _cut(documents: DataFrame, starts: str, number: int) -> DataFrame:
    cut = documents.select("*", F.posexplode(starts).alias("_k", "start"))
    return cut.withColumn("stops", F.slice(starts, F.col("_k") + 2, F.size(starts))).drop("_k", starts).repartition(number, "path", "start")


def read(spark: SparkSession, path: str, span: int = 1 << 24) -> DataFrame:
    """document, path, bytes, the settings, chunks (counted), verdict and parts (where tasks may begin) of each document (a file or a folder of *.json).

    index_unreadable where the text is no such document or is cut; its settings are those before the damage. A document is
    parsed in parts of about `span` bytes, each from where a file seems to begin until one begins at the start of a later
    part. Those from the document's begin on, each where the one before has ended, are the document; what else was tried is dropped.
    """

    def run(batches):
        for batch in batches:
            for name, size, start, stops in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "start", "stops")), strict=True):
                held, chunks, broken, after = {}, 0, False, None
                store, where = ordered.store_of(name)
                try:
                    with store.open_input_file(where) as file:
                        for kind, *rest in events(Part(file, start, stops), inside=start > 0):
                            if kind == "field":
                                held |= {rest[0]: rest[1]} if rest[0] in (*TEXTS, *NUMBERS) else {}
                            elif kind == "next":
                                after = rest[0]
                            else:
                                chunks += 1
                except ValueError:
                    broken = True
                row = [name, size, start, after, json.dumps(held), chunks, broken]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["path", "bytes", "start", "after", "held", "chunks", "broken"])

    def judge(rows):
        parts, held, chunks, at = {r["start"]: r for r in rows.to_pylist()}, {}, 0, 0
        found = []
        while at is not None:
            r = parts[at]
            held |= json.loads(r["held"])
            chunks += r["chunks"]
            found.append(at)
            at = r["after"]
        verdict = "index_unreadable" if r["broken"] else "ok" if _whole(held.get("format")) == FORMAT else "unsupported_index"
        row = [r["path"].rsplit("/", 1)[1], r["path"], r["bytes"], *(_text(held.get(c)) for c in TEXTS), *(_whole(held.get(c)) for c in NUMBERS), chunks, verdict, found]
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.string()] * len(TEXTS), *[pa.int64()] * len(NUMBERS), pa.int64(), pa.string(), pa.list_(pa.int64())]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["document", "path", "bytes", *TEXTS, *NUMBERS, "chunks", "verdict", "parts"])

    tried = _starts(_paths(spark, path), span).mapInArrow(run, "path string, bytes long, start long, after long, held string, chunks long, broken boolean")
    return tried.groupBy("path").applyInArrow(judge, f"document string, path string, bytes long, {HEADER}, chunks long, verdict string, parts array<long>")


_slot: dict[str, object] = {}


def cached(spark: SparkSession, path: str) -> DataFrame:
    """read(path), kept while the files' names, times and sizes stay; one document set is kept at a time."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.Path(f"{path}*"))
    found = [f for s in files for f in ([s] if s.isFile() else s.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(s.getPath()))]
    key = (path, tuple(sorted((f.getPath().toString(), f.getModificationTime(), f.getLen()) for f in found)))
    if _slot.get("key") != key:
        if _slot:
            _slot["rows"].unpersist()
        _slot.update(key=key, rows=read(spark, path).persist())
    return _slot["rows"]


def chunks(documents: DataFrame, rows: int = 512) -> DataFrame:
    """document, file, digest, pos, text, heading, line_start, line_end, vector of the readable documents of read(), part by part."""
    names = [c.split()[0] for c in CHUNK.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.float64())]

    def run(batches):
        def made(held):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for path, start, stops in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "stops")), strict=True):
                store, where = ordered.store_of(path)
                held = []
                with store.open_input_file(where) as file:
                    for kind, *rest in events(Part(file, start, stops), inside=start > 0):
                        if kind != "chunk":
                            continue
                        file, digest, pos, c = rest
                        c = c if isinstance(c, dict) else {}
                        lines, vector = (c.get(k) if isinstance(c.get(k), list) else [] for k in ("lines", "vector"))
                        lines = [_whole(x) for x in [*lines, None, None][:2]]
                        held.append((path.rsplit("/", 1)[1], _text(file), _text(digest), pos, _text(c.get("text")), _text(c.get("heading")) or "", *lines, [float(x) for x in vector] if vector else None))
                        if len(held) >= rows:
                            yield made(held)
                            held = []
                if held:
                    yield made(held)

    good = documents.where("verdict = 'ok'").select("path", "parts")
    return _cut(good, "parts", int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, CHUNK)


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes an index as one JSON document; returns one row: path, files, chunks, bytes.

    The cluster sorts files and chunks by range, and each task writes its range's files as text, with their chunks; one
    task then joins these pieces of the document, byte by byte. The document gets its name when it is whole.
    """
    spark = tables["header"].sparkSession
    ship(spark)
    header = tables["header"].first().asDict()  # one row
    lone = tables["chunk"].select("file", "pos", "text", "heading", "line_start", "line_end", "vector")
    rows = tables["file"].select("file", "digest").join(lone, "file", "left")
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = (F.split("file", "/"), F.col("file"))  # a file is in one range
    rows = rows.repartitionByRange(number, *order).sortWithinPartitions(*order, "pos")
    folder = f"{scratch(spark)}/{uuid.uuid4().hex[:12]}"
    there, where = files_of(spark, folder)
    there.mkdirs(where)

    def write(batches):
        part, name = TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}"  # of tries of a task the last is told
        files = chunks = 0
        last = None
        store, at = ordered.store_of(name)
        with store.open_output_stream(at) as raw, pa.CompressedOutputStream(raw, "zstd") as out:
            for batch in batches:
                for begin in range(0, batch.num_rows, ROWS):
                    for r in batch.slice(begin, ROWS).to_pylist():
                        if (r["file"], r["digest"]) != last:
                            out.write(((("]}, " if last else "") + json.dumps({"file": r["file"], "digest": r["digest"]}, ensure_ascii=False)[:-1]) + ', "chunks": [').encode())
                            last, first, files = (r["file"], r["digest"]), True, files + 1
                        if r["pos"] is not None:
                            chunk = {"text": r["text"], "heading": r["heading"], "lines": [r["line_start"], r["line_end"]], "vector": r["vector"]}
                            out.write((("" if first else ", ") + json.dumps(chunk, ensure_ascii=False)).encode())
                            first, chunks = False, chunks + 1
            if last:
                out.write(b"]}")
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([files], pa.int64()), pa.array([chunks], pa.int64())], ["part", "name", "files", "chunks"])

    told = sorted(rows.mapInArrow(write, "part int, name string, files long, chunks long").collect())  # a row a task
    names = [r.name for r in told if r.files]

    def join(batches):
        store, target = ordered.store_of(path)
        draft = f"{target}.{uuid.uuid4().hex}.draft"
        size = 0
        for batch in batches:
            with store.open_output_stream(draft) as out:
                size += out.write((json.dumps(header, ensure_ascii=False)[:-1] + ', "files": [').encode())
                for k, name in enumerate(n for x in batch.column("names").to_pylist() for n in x):
                    size += out.write(b", ") if k else 0
                    held, at = ordered.store_of(name)
                    with held.open_input_stream(at, compression="zstd") as stream:
                        while data := stream.read(1 << 22):
                            size += out.write(data)
                size += out.write(b"]}")
            store.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int64())], ["bytes"])

    size = spark.createDataFrame([(names,)], "names array<string>").coalesce(1).mapInArrow(join, "bytes long").collect()[0].bytes
    there.delete(where, True)
    return spark.createDataFrame([(path, sum(r.files for r in told), sum(r.chunks for r in told), size)], "path string, files long, chunks long, bytes long")
