"""Host-level quality rules.

Each document gets counts and a base verdict. Failures are summed by host, each host's failure rate is shrunk towards
the rate of all hosts by a beta prior fitted to the hosts themselves (moments of their rates), and a host whose shrunk
rate is above `max_host_rate` loses all its documents. The verdict is joined back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, ragged, runs, table, tune
from .flat import WHITE, flat, small, span_hashes, window_starts, windows, word_bounds, word_counts

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_text(hits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(hits, dtype=np.int64)])[offsets])


def _salted(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(keys + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def text_counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text: words, code points in words, symbols, repeated lines, words in repeated 3-word windows."""
    n = len(offsets) - 1
    starts, ends = word_bounds(buf, offsets)
    solid = ~WHITE[buf]
    out = {"n_words": word_counts(starts, offsets), "word_chars": _per_text(solid & ((buf & 0xC0) != 0x80), offsets), "n_symbols": _per_text(SYMBOLS[buf], offsets)}

    breaks = np.flatnonzero(buf == 10)
    first = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    first = first[first < len(buf)]
    doc = np.searchsorted(offsets, first, "right") - 1
    at = np.searchsorted(breaks, first)
    last = np.minimum(np.append(breaks, len(buf))[at], offsets[doc + 1])
    filled = np.concatenate([[0], np.cumsum(solid)])
    worded = filled[last] > filled[first]
    first, last, doc = first[worded], last[worded], doc[worded]
    _, example = np.unique(_salted(span_hashes(buf, first, last), doc), return_index=True)
    out["n_dup_lines"] = np.bincount(doc, minlength=n) - np.bincount(doc[example], minlength=n)

    index, of = window_starts(starts, offsets, 3)
    twice = np.zeros(len(starts) + 3, bool)
    if len(index):
        key = _salted(windows(span_hashes(buf, starts, ends), 3)[index], of)
        order = np.argsort(key)
        head = runs(key[order])
        size = np.diff(np.append(head, len(key)))
        again = index[order[ragged(head[size > 1], size[size > 1])]]
        for k in range(3):
            twice[again + k] = True
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(twice[: len(starts)], dtype=np.int64)])[np.searchsorted(starts, offsets)])
    return out


def document_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the counts and base verdict of each row. A null text counts as empty and fails."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in small(batches):
            counts = text_counts(*flat(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), *(pa.array(counts[c], pa.int64()) for c in COUNTS)], ["doc_id", "host", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS))
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_rates(counts: DataFrame) -> DataFrame:
    """host, docs, failed, rate: the posterior mean under the fitted beta prior. A null host is a host of its own."""
    hosts = counts.groupBy("host").agg(F.count("*").alias("docs"), F.count_if("base_failed").alias("failed"))
    rate = F.col("failed") / F.col("docs")
    m, v, noise = hosts.agg(F.avg(rate), F.var_samp(rate), F.avg(1 / F.col("docs"))).first()
    m = min(max(m if m is not None else 0.5, 1e-3), 1 - 1e-3)
    between = max((v or 0.0) - m * (1 - m) * (noise or 0.0), 1e-6)
    strength = min(max(m * (1 - m) / between - 1, 1.0), 1e4)
    return hosts.withColumn("rate", (F.col("failed") + F.lit(m * strength)) / (F.col("docs") + F.lit(strength)))


def judge(docs: DataFrame, *, host: str = "source", max_host_rate: float = 0.5) -> DataFrame:
    """doc_id, host, the counts, base_failed, host_rate, kept: one row per input row, repeated rows included.

    Null doc_id and null host are kept as they are; an empty table gives an empty result; further columns are ignored.
    """
    counts = materialise(document_counts(docs, host))
    hosts = host_rates(counts).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    rows = counts.join(hosts, counts["host"].eqNullSafe(hosts["_host"])).drop("_host")
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate))


def op6_quality(spark, sf_dir):
    """doc_id, the counts, base_failed and kept of every document; null texts have no words and fail, other odd rows as in `judge`."""
    return judge(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
tri AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM rep) GROUP BY r),
c AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS docs, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source),
m AS (SELECT least(greatest(avg(failed / docs), 0.001), 0.999) AS m, coalesce(var_samp(failed / docs), 0) AS v, avg(1 / docs) AS noise FROM h),
s AS (SELECT m, least(greatest(m * (1 - m) / greatest(v - m * (1 - m) * noise, 1e-6) - 1, 1), 1e4) AS s FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (failed + m * s) / (docs + s) <= 0.5 AS kept
FROM b JOIN h ON b.source IS NOT DISTINCT FROM h.source, s
"""
