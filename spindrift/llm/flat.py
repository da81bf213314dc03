"""Texts of an Arrow batch as one byte array, and the hashes of their words, computed for all texts at once.

Words are the runs of bytes other than 32 and 9 to 13, which no UTF-8 character outside ASCII contains. A word's hash
is a 64-bit polynomial over mixed byte values, finished by a mixer; equal hashes are taken for equal words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .common import mix

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLOCK = 1 << 22
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_P = 0xD6E8FEB86659FD93
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        if n <= 2 * BLOCK:
            _powers[base] = got
    return got[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def small(batches, column: str = "text", most: int = 1 << 20):
    """The batches cut into slices of about so many bytes of one column, whole rows each; a longer text is alone."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < len(sizes):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; no word crosses texts."""
    solid = ~WHITE[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    start[edge], end[edge - 1] = solid[edge], solid[edge - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; spans are in order and do not overlap. Memory follows BLOCK, not the texts."""
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        part = buf[base : ends[to - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUE[part] * _power(_P, len(part)), out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * _power(_INV, len(part))[s] + (e - s).astype(np.uint64))
        at = to
    return out


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes, and the place of each hash among them, as numpy's unique gives them.

    Of the hashes in a slot of a table the one written last stands for its equals; only hashes beside it are sorted whole.
    """
    bits = min(max((2 * len(hashes)).bit_length(), 8), 22)
    slot = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    table = np.zeros(1 << bits, np.int32)
    table[slot] = np.arange(len(hashes), dtype=np.int32)
    first = table[slot]
    beside = np.flatnonzero(hashes[first] != hashes)
    heads = np.flatnonzero(first == np.arange(len(hashes), dtype=np.int32))
    others, which = np.unique(hashes[beside], return_inverse=True)
    every = np.concatenate([hashes[heads], others])
    order = np.argsort(every)
    rank = np.empty(len(every), np.int64)
    rank[order] = np.arange(len(every))
    table[slot[heads]] = rank[: len(heads)]
    place = table[slot].astype(np.int64)
    place[beside] = rank[len(heads) :][which]
    return every[order], place


def word_counts(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of words of each text."""
    return np.diff(np.searchsorted(starts, offsets))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive words, over all texts; the caller keeps those within a text."""
    n = max(0, len(hashes) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + n]
    return mix(out)


def window_starts(starts: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first words of all windows within texts, and the text of each."""
    first = np.searchsorted(starts, offsets)
    counts = np.maximum(0, np.diff(first) - size + 1)
    from .common import ragged

    return ragged(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)
