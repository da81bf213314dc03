"""Removal of repeated passages by suffix arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller id. Every such string
(window) has an anchor: the least 16-byte hash in it, so equal windows have equal anchors at equal places. A run of
windows with one anchor is a context, at most 35 windows and 84 bytes. Three passes, all keyed by hashes:

1. Anchors go to buckets, one row of arrays a bucket and task, those of a task that are equal once with the smallest and
   the largest id. An anchor that two documents hold is asked for wherever it stands. Most anchors end here.
2. The bytes of the contexts asked for meet in buckets by anchor. Contexts of a group of documents that are equal, byte
   by byte, are sent once, with the smallest id. A suffix array over a bucket's contexts, by two-stage sorting, puts
   equal windows side by side; adjacent common prefixes of `LENGTH` or more give the windows that go. Hashes only bring
   windows together; what goes is decided by bytes.
3. The verdicts meet the texts again, and the covered bytes are cut out.

Texts are dealt out by doc_id, in groups whose number follows the bytes of the input. A passage held by very many
documents is one record for each group that holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, groups_of, joined, materialise, mix, ragged, runs, table, tune
from .flat import flat, small, span_hashes

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
BLOCK = 1 << 20
FLUSH = 1_500_000
MOST_TASKS = 20_000
LAST = np.int64(2**63 - 1)  # stands for a null id, which comes after all others
_VALUE = mix(np.arange(257, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_HIGH = np.uint64(0xFFFFFFFFFFFF0000)


def anchors(buf: np.ndarray, offsets: np.ndarray, block: int | None = None) -> dict[str, np.ndarray]:
    """The contexts of all texts: anchor hash, context hash, text, first window and number of windows.

    Works in blocks of window starts. A context that blocks cut is joined again by the place of its anchor, so contexts
    depend on their text alone and not on where it lies in the buffer.
    """
    block = block or BLOCK
    out: dict[str, list] = {k: [] for k in ("h", "place", "doc", "start", "last", "first_edge", "last_edge")}
    for at in range(0, max(0, len(buf) - LENGTH + 1), block):
        to = min(at + block, len(buf) - LENGTH + 1)
        low = np.clip(offsets[:-1], at, to)
        counts = np.maximum(0, np.clip(offsets[1:] - LENGTH + 1, at, to) - low)
        window = ragged(low, counts) - at
        if not len(window):
            continue
        h = _VALUE[buf[at : to + LENGTH - 1]]
        for k in range(4):
            h = (h[: -(1 << k)] ^ (h[: -(1 << k)] >> np.uint64(31))) * _ODD[k] + h[1 << k :]
        h = mix(h)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= SPAN:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (SPAN - span)], least[SPAN - span :])
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[window]
        head = runs(place)
        a, b = window[head], window[np.append(head[1:], len(window)) - 1]
        edge = lambda i: mix(h[i] * _ODD[0] + h[i + 16] * _ODD[1] + h[i + 32] * _ODD[2] + h[i + 34] * _ODD[3])  # noqa: E731, B023
        out["h"].append(h[place[head]])
        out["place"].append(place[head] + at)
        out["doc"].append(np.repeat(np.arange(len(counts)), counts)[head])
        out["start"].append(a + at)
        out["last"].append(b + at)
        out["first_edge"].append(edge(a) * _ODD[4])
        out["last_edge"].append(edge(b) * _ODD[5])
    if not out["h"]:
        kinds = {"h": np.uint64, "ctx": np.uint64}
        return {k: np.zeros(0, kinds.get(k, np.int64)) for k in ("h", "ctx", "doc", "start", "count")}
    got = {k: np.concatenate(out.pop(k)) for k in list(out)}
    head = runs(got["place"])  # a place lies in one text, and the windows of an anchor are in a row
    tail = np.append(head[1:], len(got["place"])) - 1
    start, span = got["start"][head], got["last"][tail] - got["start"][head]
    ctx = mix(got["first_edge"][head] + got["last_edge"][tail] + span.astype(np.uint64))
    return {"h": got["h"][head], "ctx": ctx, "doc": got["doc"][head], "start": start, "count": span + 1}


def two_stage(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The positions of `wanted`, in the order of the suffixes that start there, equal up to LENGTH bytes in any order.

    text: contexts of bytes above 0, each closed by a 0, the whole followed by LENGTH zeros. Suffixes smaller than
    their successors are sorted directly, by their first LENGTH bytes. The others are induced: scanning the buckets of
    first bytes upwards, the predecessor of each suffix met, if larger, is next in the bucket of its first byte.
    """
    n = len(text) - LENGTH
    step = np.flatnonzero(text[: n - 1] != text[1:n])
    end = np.append(step, n - 1)[np.searchsorted(step, np.arange(n))]  # last position of the run of equal bytes
    smaller = text[end] < text[np.minimum(end + 1, n - 1)]
    smaller |= text[:n] == 0
    rest = np.concatenate([np.flatnonzero(smaller), [n]])
    active = np.zeros(n, bool)
    active[wanted] = True
    last = wanted[np.append(~active[wanted[1:]] | (np.diff(wanted) > 1), True)] if len(wanted) else wanted
    until = np.minimum(rest[np.searchsorted(rest, last)], n - 1)
    active[ragged(last, until - last + 1)] = True  # what the last windows of contexts are induced from

    direct = np.flatnonzero(active & smaller)
    rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{LENGTH}")[:, 0], kind="stable")]
    del rows
    first = np.searchsorted(text[direct], np.arange(257))
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    larger = active & ~smaller

    def induce(found: np.ndarray) -> None:
        before = found[found > 0] - 1
        before = before[larger[before]]
        if len(before):
            byte = text[before]
            by = np.argsort(byte, kind="stable")
            cut = runs(byte[by])
            for part in np.split(before[by], cut[1:]):
                buckets[text[part[0]]].append(part)

    for c in range(256):
        while buckets[c]:
            found = np.concatenate(buckets[c])
            buckets[c] = []
            order.append(found)
            induce(found)
        found = direct[first[c] : first[c + 1]]
        if len(found):
            order.append(found)
            induce(found)
    ranked = np.concatenate(order) if order else np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    keep[wanted] = True
    return ranked[keep[ranked]]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to LENGTH; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    for at in range(1, len(order), 1 << 16):
        to = min(len(order), at + (1 << 16))
        rows = views[order[at - 1 : to]]
        differ = rows[1:] != rows[:-1]
        out[at:to] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    return out


def _six(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits, as six bytes each."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, 2:].reshape(-1).view("V6")


def _eight(column) -> np.ndarray:
    got = joined(column, np.uint8).reshape(-1, 6)
    out = np.zeros((len(got), 8), np.uint8)
    out[:, 2:] = got
    return out.reshape(-1).view(np.uint64)


def _rows(dest: np.ndarray, arrays: list[np.ndarray], names: list[str], base: int = 0) -> pa.RecordBatch | None:
    """A packed row for each destination."""
    if not len(dest):
        return None
    order = np.argsort(dest, kind="stable")
    head = runs(dest[order])
    to = np.append(head[1:], len(order))
    cols = [pa.array((dest[order[head]] + base).astype(np.int64))]
    for a in arrays:
        a = a[order]
        cols.append(pa.array([a[x:y].tobytes() for x, y in zip(head.tolist(), to.tolist(), strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names)


def _dealt(rows: DataFrame, key: str, groups: int) -> DataFrame:
    """The rows with their groups over as many tasks as there are groups, up to a bound; a task works on one at a time."""
    return rows.repartition(max(min(groups, MOST_TASKS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def _shared(docs: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Pass 1: packed (g, a): the anchors (upper 48 bits) that several documents hold, for each group that has them."""
    none = pa.table({"g": pa.array([], pa.int64()), "a": pa.array([], pa.binary())})

    def emit(batches):
        held, size = [], 0

        def flush():
            h, doc, g = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.argsort(h, kind="stable")
            h, doc, g = h[order], doc[order], g[order]
            head = runs(h)
            number = np.diff(np.append(head, len(h)))
            several = np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head)
            yield _rows((h[head] % np.uint64(buckets)).astype(np.int64), [_six(h[head]), doc[head], several, g[head]], names)
            # What several documents of this task hold is known to be shared: each group that has it is told at once.
            told = np.flatnonzero(np.repeat(several, number))
            _, once = np.unique(mix(h[told] + mix(g[told].astype(np.uint64))), return_index=True)
            told = told[once]
            nothing = np.zeros(len(told), np.int64)
            yield _rows(g[told] + buckets, [_six(h[told]), nothing, nothing.astype(bool), nothing], names)

        for batch in small(batches, most=1 << 22):
            got = anchors(*flat(batch.column("text")))
            held.append((got["h"] & _HIGH, batch.column("id").to_numpy()[got["doc"]], batch.column("g").to_numpy()[got["doc"]]))
            size += len(got["h"])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    def meet(key, rows):
        if key[0].as_py() >= buckets:
            return pa.table({"g": pa.array(np.full(len(rows), key[0].as_py() - buckets)), "a": rows.column("a")})
        h, doc, several, g = _eight(rows.column("a")), joined(rows.column("doc"), np.int64), joined(rows.column("several"), bool), joined(rows.column("g"), np.int64)
        order = np.argsort(h, kind="stable")
        h, doc, several, g = h[order], doc[order], several[order], g[order]
        head = runs(h)
        shared = np.logical_or.reduceat(several, head) | (np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head))
        at = np.flatnonzero(np.repeat(shared, np.diff(np.append(head, len(h)))) & ~several)
        out = _rows(g[at], [_six(h[at])], ["g", "a"])
        return pa.Table.from_batches([out]) if out else none

    names = ["dest", "a", "doc", "several", "g"]
    sent = docs.select("id", "g", "text").mapInArrow(lambda b: filter(None, emit(b)), "dest long, a binary, doc binary, several binary, g binary")
    return _dealt(sent, "dest", buckets).groupBy("dest").applyInArrow(meet, "g long, a binary")


def _alike(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each span the number of the one that stands for it: of equal bytes, that of the smallest id.

    Spans of one hash and length are held against the first of them; one that differs, by a collision, stands for itself.
    """
    order = np.lexsort((np.arange(len(ids)), ids, lengths, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (lengths[order][1:] != lengths[order][:-1])
    stands = np.empty(len(order), np.int64)
    stands[order] = np.repeat(order[new], np.diff(np.append(np.flatnonzero(new), len(order))))
    for at in range(0, len(order), 1 << 16):  # byte by byte, some spans at a time
        part = np.arange(at, min(at + (1 << 16), len(order)))
        part = part[stands[part] != part]
        same = data[ragged(starts[part], lengths[part])] == data[ragged(starts[stands[part]], lengths[part])]
        equal = np.logical_and.reduceat(same, np.cumsum(lengths[part]) - lengths[part]) if len(part) else np.zeros(0, bool)
        stands[part[~equal]] = part[~equal]
    return stands


def _in_order(rows: pa.Table) -> pa.Array:
    """The rows by id and text, so that a group's contexts have the same numbers whenever it is read."""
    return pa.compute.sort_indices(rows.select(["id", "text"]), [("id", "ascending"), ("text", "ascending")])


def _asked(left: pa.Table, right: pa.Table):
    """The contexts of a group of texts whose anchors were asked for: bytes, offsets, ids, contexts, and who stands for whom."""
    buf, offsets = flat(left.column("text"))
    ids = left.column("id").to_numpy()
    got = anchors(buf, offsets)
    known = np.unique(_eight(right.column("a"))) if len(right) else np.zeros(0, np.uint64)
    own = got["h"] & _HIGH
    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own) if len(known) else np.zeros(0, np.int64)
    got = {k: v[at] for k, v in got.items()}
    stands = _alike(buf, got["start"], got["count"] + LENGTH - 1, mix(got["h"] + mix(got["ctx"])), ids[got["doc"]])
    return buf, offsets, ids, got, stands


def _compare(texts: DataFrame, asked: DataFrame, buckets: int, groups: int) -> DataFrame:
    """Pass 2: packed (g, place, mask): for contexts sent by a group, by their number there, a bit for each window that goes."""
    names = ["dest", "h", "doc", "g", "place", "count", "bytes"]
    none = pa.table({"dest": pa.array([], pa.int64())} | {c: pa.array([], pa.binary()) for c in names[1:]})
    nothing = pa.table({"g": pa.array([], pa.int64()), "place": pa.array([], pa.binary()), "mask": pa.array([], pa.binary())})

    def emit(key, left, right):
        if not len(left) or not len(right):
            return none
        buf, _, ids, got, stands = _asked(left.take(_in_order(left)), right)
        at = np.flatnonzero(stands == np.arange(len(stands)))
        if not len(at):
            return none
        at = at[np.argsort((got["h"][at] % np.uint64(buckets)), kind="stable")]
        dest = (got["h"][at] % np.uint64(buckets)).astype(np.int64)
        lengths = got["count"][at] + LENGTH - 1
        ends = np.cumsum(lengths)
        out = _rows(dest, [got["h"][at], ids[got["doc"][at]], np.full(len(at), key[0].as_py(), np.int64), at, got["count"][at].astype(np.uint8)], names[:6])
        edges = np.concatenate([[0], ends])[np.append(runs(dest), len(dest))]
        data = buf[ragged(got["start"][at], lengths)]
        return pa.Table.from_batches([out]).append_column("bytes", pa.array([data[x:y].tobytes() for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary()))

    def compare(_key, rows):
        doc, g, place = (joined(rows.column(c), np.int64) for c in ("doc", "g", "place"))
        count, data = joined(rows.column("count"), np.uint8).astype(np.int64), joined(rows.column("bytes"), np.uint8)
        if not len(doc):
            return nothing
        lengths = count + LENGTH - 1
        starts = np.cumsum(lengths) - lengths
        stands = _alike(data, starts, lengths, span_hashes(data, starts, starts + lengths), doc)
        one = np.flatnonzero(stands == np.arange(len(stands)))  # contexts that groups share are sorted once
        mask = np.zeros(len(doc), np.int64)
        mask[one] = _judged(doc[one], count[one], data[ragged(starts[one], lengths[one])])
        mask = np.where(doc > doc[stands], (np.int64(1) << count) - 1, mask[stands])
        at = np.flatnonzero(mask)
        out = _rows(g[at], [place[at], mask[at]], ["g", "place", "mask"])
        return pa.Table.from_batches([out]) if out else nothing

    rows = _dealt(texts.select("g", "id", "text"), "g", groups)
    sent = rows.groupBy("g").cogroup(_dealt(asked, "g", groups).groupBy("g")).applyInArrow(emit, "dest long, h binary, doc binary, g binary, place binary, count binary, bytes binary")
    return _dealt(sent, "dest", buckets).groupBy("dest").applyInArrow(compare, "g long, place binary, mask binary")


def _judged(doc: np.ndarray, count: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A mask for each context, a bit for each window that also starts in a document with a smaller id."""
    lengths = count + LENGTH - 1
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.zeros(int((lengths + 1).sum()) + LENGTH, np.uint8)
    text[ragged(starts, lengths)] = data + 1  # no byte of UTF-8 is 255
    wanted = ragged(starts, count)
    place = np.zeros(len(text), np.int64)
    place[wanted] = np.arange(len(wanted))
    order = two_stage(text, wanted)
    head = np.flatnonzero(common_prefixes(text, order) < LENGTH)
    of = np.repeat(doc, count)[place[order]]
    least = np.repeat(np.minimum.reduceat(of, head), np.diff(np.append(head, len(of))))
    gone = np.zeros(len(wanted), bool)
    gone[place[order]] = of > least
    first = np.cumsum(count) - count
    bit = np.int64(1) << (np.arange(len(wanted)) - np.repeat(first, count))
    return np.add.reduceat(np.where(gone, bit, 0), first)


GONE = -1  # a mask of all windows


def covered(buf: np.ndarray, got: dict[str, np.ndarray], mask: np.ndarray) -> np.ndarray:
    """Whether each byte lies in a window that goes."""
    change = np.zeros(len(buf) + 1, np.int32)
    at = np.flatnonzero(mask)
    whole = at[mask[at] == GONE]
    np.add.at(change, got["start"][whole], 1)
    np.add.at(change, got["start"][whole] + got["count"][whole] + LENGTH - 1, -1)
    part = at[mask[at] != GONE]
    for k in range(SPAN):
        some = got["start"][part[(mask[part] >> k) & 1 == 1]] + k
        np.add.at(change, some, 1)
        np.add.at(change, some + LENGTH, -1)
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame, *, with_kept: bool = True, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, text and `columns`) for each row of docs.

    text is kept as a string, without the bytes of characters that were cut in two. Of `columns`, which are docs' own
    and may have any names, one that has the name of a result is left out.

    docs: (doc_id, text, ...). A null text is empty. A null id counts as larger than all others. Rows that repeat an id
    are one document: they do not remove from each other. Texts of any length are judged whole; those under LENGTH
    bytes lose nothing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tune(spark)
    buckets = groups = groups_of(docs)
    result = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept", "text"] * with_kept
    columns = tuple(c for c in columns if c not in result)
    text = F.col("text").cast("string").alias("text")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), text, *(F.col(f"`{c}`").alias(f"_own_{k}") for k, c in enumerate(columns)))
    own = [f"_own_{k}" for k in range(len(columns))]
    texts = base.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(groups)))
    asked = materialise(_shared(texts, buckets, groups))
    collect_garbage(spark)
    masks = materialise(_compare(texts, asked, buckets, groups))
    collect_garbage(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, text string" * with_kept
    schema += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in base.select(*own).schema)

    def cut(_key, left, right):
        left = left.take(_in_order(left))
        buf, offsets, ids, got, stands = _asked(left, right)
        mask = np.zeros(len(stands), np.int64)
        replies = right.filter(pa.compute.is_valid(right.column("mask")))
        mask[joined(replies.column("place"), np.int64)] = joined(replies.column("mask"), np.int64)
        doc = ids[got["doc"]]
        gone = covered(buf, got, np.where(doc > doc[stands], GONE, mask[stands]))
        head = gone.copy()
        head[1:] &= ~gone[:-1]
        edge = offsets[:-1][offsets[:-1] < len(buf)]
        head[edge] = gone[edge]
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[offsets])
        removed = total(gone)
        rest = buf[~gone].tobytes()
        ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).tolist()
        kept = [rest[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        cols = {"doc_id": left.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(removed), "n_spans": pa.array(total(head)), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())}
        if with_kept:
            cols["kept"] = pa.array(kept, pa.binary())
            cols["text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
        return pa.table(cols | {c: left.column(c) for c in own})

    replies = asked.select("g", "a", F.lit(None).cast("binary").alias("place"), F.lit(None).cast("binary").alias("mask"))
    replies = replies.unionByName(masks.select("g", F.lit(b"").alias("a"), "place", "mask"))
    out = _dealt(texts, "g", groups).groupBy("g").cogroup(_dealt(replies, "g", groups).groupBy("g")).applyInArrow(cut, schema)
    return out.select(*result, *(F.col(a).alias(c) for a, c in zip(own, columns, strict=True)))


def op5_suffix(spark, sf_dir):
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; see dedup for nulls, repeats and long texts."""
    return dedup(table(spark, sf_dir, "documents"), with_kept=False)


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS MATERIALIZED (SELECT doc_id, o, substr(x, 2 * o + 1, 698) AS x FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49, 300)) AS o FROM d)),
w AS MATERIALIZED (SELECT doc_id, o + i AS i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, o, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM b)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.i, w.i - lag(w.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS gap FROM w JOIN f USING (s) WHERE f.least < w.doc_id),
k AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM g),
sp AS (SELECT doc_id, n, min(i) AS a, max(i) + 50 AS b FROM k GROUP BY doc_id, n),
seg AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q, b - a AS gone FROM sp
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(x)) // 2, 0 FROM d LEFT JOIN sp USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, any_value(length(x)) // 2 AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) - 1 AS n_spans, sha256(unhex(string_agg(substr(x, 2 * p + 1, 2 * (q - p)), '' ORDER BY p, q))) AS kept_sha256
FROM d JOIN seg USING (doc_id) GROUP BY d.doc_id
"""
