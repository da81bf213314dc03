"""Telephony audio in binary columns.

Payloads are stored as they are as the data of a mono WAV file, in one of three codecs: mu-law or A-law of 8 kHz, or
IMA ADPCM of 16 kHz in blocks of `UNIT` bytes; which one is told by the payload's CRC, so equal payloads are equal files.
The reader goes by the file's own format tag: it expands mu-law and A-law by lookup tables, decodes ADPCM with numpy
across all blocks of a batch at once, and resamples to 16-bit PCM of another rate with a low-pass filter. Media and PCM
are columns of tables in the shared folder, and features are computed from the stored PCM. All arithmetic is on whole
numbers, so equal payloads give equal values anywhere. Long signals are worked on in blocks.
"""

from __future__ import annotations

import functools
import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, table, tune
from .flat import small

UNIT, RATE, MULAW, ALAW, ADPCM = 192, 8000, 7, 6, 17
CODECS = {MULAW: "mulaw", ALAW: "alaw", ADPCM: "adpcm"}
RATES = {MULAW: RATE, ALAW: RATE, ADPCM: 2 * RATE}  # 8,000 bytes a second in each
BLOCK = 1 << 18  # samples, and ADPCM bytes, that are worked on at once
TAPS = 12  # samples on either side that the filter sees, at the lower of two rates

# Fixed values of the IMA ADPCM format: quantizer steps, and how a code moves the step index.
STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
MOVES = [-1, -1, -1, -1, 2, 4, 6, 8]


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, size = code >> 4 & 7, ((code & 15).astype(np.int32) << 4) + 8
    size = np.where(exponent > 0, size + 256 << np.maximum(exponent.astype(np.int32) - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()
_step, _code = np.repeat(np.array(STEPS), 16), np.tile(np.arange(16), len(STEPS))
_size = (_step >> 3) + (_step >> 2) * (_code & 1) + (_step >> 1) * (_code >> 1 & 1) + _step * (_code >> 2 & 1)
DIFFERENCE = np.where(_code & 8, -_size, _size).astype(np.int32)
NEXT = np.clip(np.repeat(np.arange(len(STEPS)), 16) + np.array(MOVES)[_code & 7], 0, len(STEPS) - 1).astype(np.int32)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (blocks, 2 * (block bytes - 4) + 1) of mono IMA blocks; one step over all blocks for each sample."""
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(body) + 1, len(blocks)), np.int16)
    out[0] = head
    for k, row in enumerate(body):
        for half, code in enumerate((row & 15, row >> 4)):
            at = index * 16 + code
            head = np.clip(head + DIFFERENCE[at], -32768, 32767)
            index = NEXT[at]
            out[2 * k + half + 1] = head
    return out.T


def wav(data: bytes, kind: int = MULAW, rate: int = RATE, block: int = 1) -> bytes:
    """A RIFF file with this data; an ADPCM file's header says how many samples its blocks hold."""
    samples = 2 * (block - 4) + 1 if kind == ADPCM else 1
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block // samples, block, 4 if kind == ADPCM else 8)
    fmt += struct.pack("<HH", 2, samples) if kind == ADPCM else struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) // block * samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format, rate and data of a RIFF file; raises ValueError where its chunks do not fit."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, kind, rate = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("chunk is cut off")
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            if kind is None:
                raise ValueError("data before fmt")
            return kind, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@functools.cache
def _filters(up: int, down: int) -> tuple[np.ndarray, int]:
    """Whole-number coefficients (up, taps), one row a phase, each of sum 2**15, and the samples seen before."""
    half = TAPS * max(1, -(-down // up))
    wide = np.arange(-half, half + 1)
    out = np.zeros((up, 2 * half + 1), np.int64)
    for phase in range(up):
        x = wide - phase / up
        cut = min(1.0, up / down)
        h = np.sinc(cut * x) * np.cos(np.pi * x / (2 * (half + 1))) ** 2
        h = np.round(h / h.sum() * (1 << 15)).astype(np.int64)
        h[half] += (1 << 15) - h.sum()
        out[phase] = h
    return out, half


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """16-bit samples at another rate: ceil(n * to / rate) of them, low-pass filtered, the ends as if silence lay beyond."""
    common = math.gcd(rate, to)
    up, down = to // common, rate // common
    taps, half = _filters(up, down)
    total = -(-len(pcm) * up // down)
    out = np.empty(total, np.int16)
    step = max(1, BLOCK // down) * up  # whole turns of the phases
    for at in range(0, total, step):
        n = min(step, total - at)
        first = at // up * down
        last = first + (n - 1) * down // up + 1
        part = np.zeros(last - first + 2 * half, np.float64)  # sums stay below 2**53: exact
        lo, hi = max(0, first - half), min(len(pcm), last + half)
        part[lo - first + half : hi - first + half] = pcm[lo:hi]
        for phase in range(min(up, n)):
            number = -(-(n - phase) // up)
            begin = phase * down // up
            own = np.correlate(part[begin : begin + (number - 1) * down + 2 * half + 1], taps[phase * down % up].astype(np.float64), "valid")[::down]
            out[at + phase : at + n : up] = np.clip((own.astype(np.int64) + (1 << 14)) >> 15, -32768, 32767)
    return out


def decoded(kinds: list[int], payloads: list[bytes], unit: int) -> list[np.ndarray]:
    """The samples of each payload; the ADPCM blocks of all of them together, some blocks at a time."""
    out: list = [None] * len(payloads)
    adpcm = [i for i, k in enumerate(kinds) if k == ADPCM]
    if adpcm:
        blocks = np.frombuffer(b"".join(payloads[i] for i in adpcm), np.uint8).reshape(-1, unit)
        every = np.empty((len(blocks), 2 * (unit - 4) + 1), np.int16)
        for at in range(0, len(blocks), most := max(1, BLOCK // unit)):
            every[at : at + most] = decode_adpcm(blocks[at : at + most])
        ends = np.cumsum([len(payloads[i]) // unit for i in adpcm])
        for i, part in zip(adpcm, np.split(every, ends[:-1]), strict=True):
            out[i] = part.reshape(-1)
    for i, k in enumerate(kinds):
        if k != ADPCM:
            if k not in CODECS:
                raise ValueError(f"format {k} is none of mu-law, A-law and IMA ADPCM")
            out[i] = (MULAW_PCM if k == MULAW else ALAW_PCM)[np.frombuffer(payloads[i], np.uint8)]
    return out


def store(docs: DataFrame, *, unit: int = UNIT, codecs: tuple[int, ...] = tuple(CODECS)) -> DataFrame:
    """doc_id, n_bytes, media: each text in UTF-8 (null: empty), filled up with blanks to a positive multiple of `unit`.

    Repeated rows, null ids, empty and very long texts each give one row; further columns are dropped, and an empty table
    gives an empty one. The codec is that of `codecs` which the CRC of the payload picks.
    """
    tune(docs.sparkSession, 500)

    def run(batches):
        for batch in small(batches, most=1 << 22):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            payloads = [t.ljust(max(1, -(-len(t) // unit)) * unit) for t in texts]
            kinds = [codecs[zlib.crc32(p) % len(codecs)] for p in payloads]
            media = [wav(p, k, RATES[k], unit if k == ADPCM else 1) for p, k in zip(payloads, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


_READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string"


def expand(stored: DataFrame, *, unit: int = UNIT, rate: int = 16000) -> DataFrame:
    """Reads media back: its payload's length and digests, its codec by the file's own tag, and pcm, 16 bits at `rate`.

    stored: (doc_id, n_bytes, media), one row each; null ids stay. A file that is no WAV of the three codecs is an error.
    """
    tune(stored.sparkSession, 500)

    def run(batches):
        for batch in small(batches, "media", 1 << 22):
            media = batch.column("media").to_pylist()
            kinds, rates, payloads = zip(*map(read_wav, media), strict=True) if media else ((), (), ())
            pcm = [resample(x, r, rate).astype("<i2").tobytes() for x, r in zip(decoded(kinds, payloads, unit), rates, strict=True)]
            cols = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(len, payloads), pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array(map(len, media), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array([CODECS[k] for k in kinds], pa.string()), pa.array(pcm, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*(f.split()[0] for f in _READ.split(", ")), "pcm"])

    return stored.mapInArrow(run, _READ + ", pcm binary")


def features(expanded: DataFrame) -> DataFrame:
    """Replaces codec and pcm by feature: the codec, and the number, energy, peak, sign changes and CRC of the samples."""
    tune(expanded.sparkSession, 500)
    names = [f.split()[0] for f in _READ.split(", ")]

    def run(batches):
        for batch in small(batches, "pcm", 1 << 22):
            found = []
            for codec, raw in zip(batch.column("codec").to_pylist(), batch.column("pcm").to_pylist(), strict=True):
                pcm = np.frombuffer(raw, "<i2")
                energy, peak, turns = 0, 0, 0
                for at in range(0, len(pcm), BLOCK):
                    part = pcm[max(0, at - 1) : at + BLOCK].astype(np.int32)  # with the sample before
                    own = part[1:] if at else part
                    energy += int(np.square(own, dtype=np.int64).sum())
                    peak = max(peak, int(np.abs(own).max()))
                    turns += int(((part[1:] < 0) != (part[:-1] < 0)).sum())
                found.append(f"{codec}:{len(pcm)},{energy},{peak},{turns},{zlib.crc32(raw):08x}")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array(found, pa.string())], [*names[:-1], "feature"])

    return expanded.select(*names, "pcm").mapInArrow(run, _READ.replace("codec string", "feature string"))


def stored_features(docs: DataFrame, *, rate: int = 16000, shares: int = 6) -> DataFrame:
    """features() of all documents, from media and PCM that were written to the shared folder and read back.

    Documents are worked on in `shares` by a hash of the text, one after the other, and a share's media and PCM go when
    its features are written: PCM of 16 kHz takes some four times the texts, and scratch space holds one share of it.
    """
    out = None
    for k in range(shares):
        media = materialise(store(docs.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(shares)) == k)))
        pcm = materialise(expand(media, rate=rate))
        release(media)
        found = materialise(features(pcm))
        release(pcm)
        out = found if out is None else out.unionByName(found)
    return out


def op8_media(spark, sf_dir):
    """doc_id, n_bytes, payload and media lengths and digests, and feature of every document, from what was stored.

    Null and empty texts are one unit of blanks; repeated rows give a row each; see store for ids and long texts. Media
    and PCM of 16 kHz are written to the shared folder and read back.
    """
    return stored_features(table(spark, sf_dir, "documents"))
