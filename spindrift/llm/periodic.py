"""Periodic runs of words: for every period a grid of positions, and around each grid point the longest common extension.

A run of at least `times` periods q agrees with itself, shifted by q, over at least (times - 1) q words, so it crosses a
grid of that spacing. Over all periods these are n / q points each, a harmonic sum. Points whose word does not come again
q words on are left at once; for all others of a batch of documents the extensions to both sides are found at the same
time, by binary search over prefix hashes of the words. What is found is verified word by word, and runs that several
points or multiples of a period found are made one. Documents are independent: there is no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, ragged, table, tune
from .flat import _INV, _P, _power, flat, small, span_hashes, word_bounds

AT_ONCE = 1 << 20  # grid points that are held at a time
OUT = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def word_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only: words of one hash are held against one of them byte by byte."""
    if not len(starts):
        return np.zeros(0, np.int64)
    _, example, ids = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    twin, size = starts[example][ids], ends - starts
    same = np.array_equal(size, (ends - starts)[example][ids])
    for at in range(0, len(starts) if same else 0, 1 << 18):
        part = slice(at, at + (1 << 18))
        if not np.array_equal(buf[ragged(starts[part], size[part])], buf[ragged(twin[part], size[part])]):
            same = False
            break
    if same:
        return ids.astype(np.int64)
    held: dict[bytes, int] = {}
    data = buf.tobytes()
    return np.array([held.setdefault(data[a:b], len(held)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)


def _longest(equal, most: np.ndarray) -> np.ndarray:
    """For each pair the largest length up to `most` for which equal(length, which) holds; all pairs take each step at once."""
    length = np.zeros(len(most), np.int64)
    for bit in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
        which = np.flatnonzero(length + (1 << bit) <= most)
        length[which[equal(length[which] + (1 << bit), which)]] += 1 << bit
    return length


def _verified(ids: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bool:
    """Whether every word of a run comes again a period on, and no neighbour carries the run on."""
    pairs = length - period
    ends, at = np.cumsum(pairs), 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        inside = ragged(start[at:to], pairs[at:to])
        if not np.array_equal(ids[inside], ids[inside + np.repeat(period[at:to], pairs[at:to])]):
            return False
        at = to
    left, right = start > first, start + length < last
    return not (ids[start[left] - 1] == ids[(start + period)[left] - 1]).any() and not (ids[(start + length)[right]] == ids[(start + length - period)[right]]).any()


def _scanned(ids: np.ndarray, offsets: np.ndarray, times: int, least: int):
    """The same runs by comparing all words at every distance; for texts whose prefix hashes are not to be trusted."""
    rows = []
    for doc, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own, found = ids[a:b], {}
        for q in range(1, (b - a) // times + 1):
            again = np.flatnonzero(np.diff(np.concatenate([[0], (own[q:] == own[:-q]).astype(np.int8), [0]])))
            for s, e in again.reshape(-1, 2).tolist():
                if e - s + q >= max(least, times * q):
                    found.setdefault((s, e - s + q), q)
        rows += [(doc, s, n, q) for (s, n), q in found.items()]
    out = np.array(sorted(rows, key=lambda r: (r[0], r[1], r[3])), np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def find_runs(ids: np.ndarray, offsets: np.ndarray, times: int = 4, least: int = 6):
    """doc, start (in the document), length, period of all runs of documents ids[offsets[d]:offsets[d + 1]], by doc, start and period."""
    sizes = np.diff(offsets)
    most = sizes // times
    doc = np.repeat(np.arange(len(sizes)), most)
    period = ragged(np.ones(len(sizes), np.int64), most)
    spacing = (times - 1) * period
    points = -(-(sizes[doc] - period) // spacing)
    values = mix((ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    prefix = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(values * _power(_P, len(ids)), out=prefix[1:])
    shift = _power(_P, int(most.max(initial=0)) + 1)
    found = []
    ends = np.cumsum(points)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        n = points[at:to]
        which = np.repeat(np.arange(at, to), n)
        x = ragged(np.zeros(to - at, np.int64), n) * spacing[which] + offsets[doc[which]]
        again = ids[x] == ids[x + period[which]]
        x, which = x[again], which[again]
        at = to
        if not len(x):
            continue
        d, q = doc[which], period[which]
        p = shift[q]

        def same(low, high, q=q, p=p):  # the words low..high are those q further on
            return lambda length, k: (prefix[high(length, k)] - prefix[low(length, k)]) * p[k] == prefix[high(length, k) + q[k]] - prefix[low(length, k) + q[k]]

        ahead = _longest(same(lambda n, k: x[k], lambda n, k: x[k] + n), offsets[d + 1] - x - q)
        back = _longest(same(lambda n, k: x[k] - n, lambda n, k: x[k]), x - offsets[d])
        length = back + ahead + q
        ok = length >= np.maximum(least, times * q)
        found.append(np.stack([d[ok], (x - back - offsets[d])[ok], length[ok], q[ok]]))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    d, s, n, q = np.concatenate(found, 1)
    order = np.lexsort((q, n, s, d))
    d, s, n, q = d[order], s[order], n[order], q[order]
    one = np.ones(len(d), bool)  # a stretch found with several periods has the smallest, which divides the others
    one[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1])
    d, s, n, q = d[one], s[one], n[one], q[one]
    order = np.lexsort((q, s, d))
    d, s, n, q = d[order], s[order], n[order], q[order]
    if not _verified(ids, offsets[d], offsets[d + 1], s + offsets[d], n, q):
        return _scanned(ids, offsets, times, least)
    return d, s, n, q


def _texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The words joined by one space; counts: how many words each text has."""
    size = ends - starts + 1
    out = np.append(buf, np.uint8(32))[ragged(starts, size)] if len(size) else np.zeros(0, np.uint8)
    stop = np.cumsum(size)
    out[stop - 1] = 32
    edge = np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(counts)])]
    data = out.tobytes()
    return pa.array([data[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)], pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, *, times: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), collapsed of each row of docs(doc_id, text).

    A run is a stretch of words that come again a period on, as long as it can be, of at least `times` periods and
    `least` words; period is the smallest one. collapsed: the words outside all runs and the first period of each, joined
    by one space (a word that any run drops is dropped). A null text has no words, no runs and an empty collapsed text; a
    null doc_id stays null; rows that repeat are judged each; an empty table gives no rows; further columns are ignored.
    Texts of any length are taken whole; memory follows the words of one text or of about 1 MB of shorter ones.
    """
    tune(docs.sparkSession)

    def run(batches):
        for batch in small(batches):
            buf, offsets = flat(batch.column("text"))
            starts, ends = word_bounds(buf, offsets)
            first = np.searchsorted(starts, offsets)
            d, s, n, q = find_runs(word_ids(buf, starts, ends), first, times, least)
            gone = np.zeros(len(starts) + 1, np.int64)
            np.add.at(gone, first[d] + s + q, 1)
            np.add.at(gone, first[d] + s + n, -1)
            kept = np.cumsum(gone)[:-1] == 0
            number = np.diff(np.concatenate([[0], np.cumsum(kept)])[first])
            spans = pa.StructArray.from_arrays([pa.array(s), pa.array(n), pa.array(q)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(d, np.arange(batch.num_rows + 1)).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(first)), lists, _texts(buf, starts[kept], ends[kept], number)], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text where each tenth document, by a hash of its id, goes on from some word on as a repetition of the words there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h.alias("_h"), F.when(h % 10 == 0, words).alias("_w"))
    n, g = F.coalesce(F.size("_w"), F.lit(0)), F.floor(F.col("_h") / 10)
    rows = rows.withColumn("_n", n).withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")).cast("int")).withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    times = F.ceil((F.col("_n") - F.col("_a")) / F.col("_p")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), times)), F.lit(1), F.col("_n") - F.col("_a"))
    return rows.select("doc_id", F.when(F.col("_n") > 0, F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), again), " ")).otherwise(F.col("text")).alias("text"))


def longest(spans: Column) -> Column:
    """The run of the greatest length; of several the one that starts first, and of these the one with the smallest period."""
    return F.array_max(F.transform(spans, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def op11_periodic(spark, sf_dir):
    """The runs of every document, after the contract's rewriting: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256.

    A null doc_id has no hash and is not rewritten; other odd rows as in `periodic_runs`.
    """
    got = periodic_runs(planted(table(spark, sf_dir, "documents"))).withColumn("best", longest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    length, period = F.col("best.length"), -F.col("best.period")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return got.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"), digest(lines).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


# Equal words of a document in pairs, q apart; consecutive pairs of one q are islands. The hash of the id is CRC-32, bit by bit.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0])), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM documents),
k AS (SELECT *, len(w)::BIGINT AS n, h // 10 AS g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM k),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
m AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
x AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(w) AS w FROM m),
e AS (SELECT x.r, x.n, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 4),
l AS (SELECT r, q, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island, i FROM e),
s AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM l GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
u AS (SELECT r, s, len, min(q) AS q FROM s GROUP BY r, s, len),
b AS (SELECT r, count(*) AS n_runs, arg_min(struct_pack(s := s, len := len, q := q), (-len, s, q)) AS best, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM u GROUP BY r),
z AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM u),
c AS (SELECT x.r, string_agg(x.w, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN z ON z.r = x.r AND z.i = x.i GROUP BY x.r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len::BIGINT AS length, best.q::BIGINT AS period, (1000 * best.len // best.q)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (r) LEFT JOIN c USING (r)
"""
