"""WARC archives: a writer, and a sequential reader of one gzip member per record.

The reader decompresses incrementally, frames each record by its Content-Length, requires the member to end with
the record, and checks the block digest and, for responses, the payload digest. It never holds more of a payload
than its caller asks for; headers may have any length. A damaged record gives a row with `error`, and reading goes on
at the next gzip member that holds a record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shared_folder, table, tune
from .flat import small

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK = 1 << 16
MAX_BROADCAST = 200_000  # revisits of some 40 bytes each that are sent to all workers; more are joined by a shuffle
RECORD = "record_type string, record_id string, refers_to_id string, target_uri string, payload_digest string, payload_bytes long, payload binary, archive string, record_no long, error string"


def digest32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(kind: str, record_id: str, uri: str, payload: bytes, sha1: bytes, refers_to: str | None = None, level: int = 5) -> bytes:
    """A response or revisit as one gzip member. A revisit keeps the HTTP head, which states the payload's length."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest32(sha1)}", f"WARC-Block-Digest: sha1:{digest32(hashlib.sha1(block).digest())}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", level, mtime=0)


class Damaged(ValueError):
    pass


class _Source:
    """A stream's bytes from any place on: one read chunk, and seeking where the next member is looked for again."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def read(self, n: int = CHUNK) -> bytes:
        data = self.stream.read(n)
        self.at += len(data)
        return data

    def seek(self, at: int) -> None:
        self.stream.seek(at)
        self.at = at


class _Member:
    """Bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, source: _Source, ahead: bytes):
        self.source, self.inflate, self.raw, self.out, self.ended = source, zlib.decompressobj(31), ahead, bytearray(), False

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.raw or self.inflate.unconsumed_tail or self.source.read()
        self.raw = b""
        if not data:
            raise Damaged("archive ends inside a member")
        try:
            self.out += self.inflate.decompress(data, CHUNK * 4)
        except zlib.error as e:
            raise Damaged(f"bad gzip data: {e}") from e
        if self.inflate.eof:
            self.ended, self.raw = True, self.inflate.unused_data
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark) + 1)
            if not self.more():
                raise Damaged("no end of header")
        got = bytes(self.out[:at])
        del self.out[: at + len(mark)]
        return got

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            while not self.out:
                if not self.more():
                    raise Damaged("block is shorter than Content-Length")
            got = bytes(self.out[:n])
            del self.out[: len(got)]
            n -= len(got)
            yield got

    def finish(self) -> None:
        while not self.ended:
            self.more()
            if len(self.out) > 4:
                break
        if self.out != b"\r\n\r\n" or not self.ended:
            raise Damaged("member does not end with the record")


def _fields(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        out.setdefault(key.strip().lower(), value.strip())
    return out


def _begins(data: bytes) -> bool:
    """Whether a gzip member that holds a record starts here."""
    try:
        got = zlib.decompressobj(31).decompress(data, 5)
    except zlib.error:
        return False
    return len(got) > 0 and b"WARC/".startswith(got)


def _next_member(source: _Source, start: int) -> bytes:
    """What follows from the first member that starts after `start`, bytes that were read already included."""
    source.seek(start)
    ahead = source.read()
    while ahead:
        at = ahead.find(b"\x1f\x8b\x08")
        if at < 0:
            more = source.read()
            ahead = ahead[-2:] + more if more else b""
            continue
        ahead = ahead[at:]
        if len(ahead) < 1 << 12:
            ahead += source.read()
        if _begins(ahead):
            return ahead
        ahead = ahead[1:]
    return b""


def read_records(stream, with_payload: bool = True) -> Iterator[dict]:
    """The records of one archive, in order. The stream must be seekable: after damage the search for the next member
    starts one byte behind the start of the damaged one, so records that follow are not lost with it."""
    source = _Source(stream)
    ahead = source.read()
    while ahead:
        start = source.at - len(ahead)
        member, row = _Member(source, ahead), dict.fromkeys(("type", "id", "refers_to", "uri", "digest", "bytes", "payload", "error"))
        try:
            f = _fields(member.until(b"\r\n\r\n"))
            row |= {"type": f.get("warc-type"), "id": f.get("warc-record-id", "").strip("<>"), "uri": f.get("warc-target-uri"), "refers_to": f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None}
            left, block_sha, sha, kept, http = int(f["content-length"]), hashlib.sha1(), hashlib.sha1(), [], bytearray()
            in_head = "application/http" in f.get("content-type", "")
            size = 0
            for piece in member.take(left):
                block_sha.update(piece)
                if in_head:
                    seen = max(0, len(http) - 3)
                    http += piece
                    if (at := http.find(b"\r\n\r\n", seen)) < 0:
                        continue
                    piece, http, in_head = bytes(http[at + 4 :]), http[:at], False
                sha.update(piece)
                size += len(piece)
                if with_payload:
                    kept.append(piece)
            member.finish()
            stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
            if (block := f.get("warc-block-digest")) and block != f"sha1:{digest32(block_sha.digest())}":
                raise Damaged("block digest differs")
            if row["type"] == "revisit":
                row |= {"digest": stated, "bytes": int(_fields(bytes(http)).get("content-length", -1))}
            else:
                row |= {"digest": digest32(sha.digest()), "bytes": size, "payload": b"".join(kept) if with_payload else None}
                if stated and stated != row["digest"]:
                    raise Damaged("payload digest differs")
            ahead = member.raw or source.read()
        except (Damaged, KeyError, ValueError) as e:
            row["error"] = f"{type(e).__name__}: {e}"
            ahead = member.raw or source.read() if member.ended else _next_member(source, start + 1)
        yield row


def _open(uri: str):
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where, path


def write_archives(pages: DataFrame, folder: str, *, min_revisit_bytes: int = 0, roll_bytes: int = 1 << 30, level: int = 5) -> DataFrame:
    """Writes pages(page_id, url, html) to archives in `folder` and returns (archive, records, bytes), already computed.

    Of pages whose payloads are equal and of at least `min_revisit_bytes`, that with the largest page_id (null is
    smallest) is a response and the others are revisits of it; where rows repeat that page_id, each such row is a
    response. A null html is an empty payload, a null url an empty target. An archive is written under a name of its
    own attempt, so a retried task leaves no half-read file in the manifest. Further columns of `pages` are ignored.
    """
    spark = pages.sparkSession
    tune(spark, 500)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    # Only pages with a copy meet others, and only by id and digest; payloads stay where they are read.
    small_rows = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("sha1", "page_id").agg(F.lit(1).alias("_one"))
    first = small_rows.groupBy("sha1").agg(F.max("page_id").alias("first_id"), F.count("*").alias("_n")).where("_n > 1 AND first_id IS NOT NULL")
    revisits = materialise(small_rows.join(first, "sha1").where("NOT page_id <=> first_id").select(F.col("sha1").alias("_sha1"), F.col("page_id").alias("_id"), "first_id"))
    if revisits.count() <= MAX_BROADCAST:
        revisits = F.broadcast(revisits)
    rows = rows.join(revisits, (F.col("sha1") == F.col("_sha1")) & F.col("page_id").eqNullSafe(F.col("_id")), "left").select("page_id", "url", "payload", "sha1", "first_id")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        where, path = _open(folder)
        where.create_dir(path, recursive=True)
        out, name, count, size, no = None, "", 0, 0, 0
        done = []
        for batch in small(batches, "payload", 4 << 20):
            for page_id, url, payload, sha1, first_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "first_id")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{no:04d}.warc.gz"
                    out, count, size, no = where.open_output_stream(f"{path}/{name}", compression=None), 0, 0, no + 1
                uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
                revisit = first_id is not None
                data = record("revisit" if revisit else "response", f"urn:page:{page_id}", uri, payload, sha1, f"urn:page:{first_id}", level)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    out = None
                    done.append((f"{folder}/{name}", count, size))
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return materialise(rows.mapInArrow(write, "archive string, records long, bytes long"))


def read_archives(manifest: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records of the archives named in manifest(archive); one task reads an archive from its start to its end."""
    tune(manifest.sparkSession, 500)
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("archive", pa.string()), ("record_no", pa.int64()), ("error", pa.string())])

    def read(batches):
        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            for archive in b.column("archive").to_pylist():
                where, path = _open(archive)
                held, size = [], 0
                with where.open_input_file(path) as stream:
                    for no, r in enumerate(read_records(stream, with_payload)):
                        held.append((r["type"], r["id"], r["refers_to"], r["uri"], r["digest"], r["bytes"], r["payload"], archive, no, r["error"]))
                        size += len(r["payload"] or b"") + 200
                        if size > 4 << 20:
                            yield batch(held)
                            held, size = [], 0
                if held:
                    yield batch(held)

    return manifest.select("archive").repartition(tasks).mapInArrow(read, RECORD)


def _page(column: str):
    return F.regexp_extract(column, r"^urn:page:(-?\d+)$", 1).try_cast("long")


def op1_warc(spark, sf_dir):
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from its archive.

    A null html is an empty payload and a null url an empty target. A null page_id is read back as null, and is a
    revisit where a page with an id has the same payload. Repeated rows of the largest page_id are all responses.
    Payloads and urls of any length are read back whole; an empty table gives an empty result.
    """
    manifest = write_archives(table(spark, sf_dir, "pages"), shared_folder(spark), min_revisit_bytes=0)
    got = read_archives(manifest, with_payload=False)
    return got.select(
        _page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        _page("refers_to_id").alias("refers_to"), F.col("error").alias("read_error"),
    )


ORACLE = """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS top FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to, NULL::VARCHAR AS read_error FROM m
"""
