"""Packing by power-of-two decomposition.

A document of L tokens becomes L // 2048 pieces of 2048 tokens and one piece for each bit of the rest, longest first.
Every piece is a training sequence of its own: its length is a power of two, so nothing is padded and no sequence
crosses documents. Sequences of one length form a bucket, from which batches of equal shape are drawn.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, table, tune
from .flat import LOWER, flat, small, span_hashes, word_bounds

MOST = 2048
CACHE = 2_000_000  # distinct pieces whose ids a worker holds; beyond that it starts anew
SLOT_BITS = 21  # of a hash, for the table in which most pieces are found again
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)  # control characters, "'", "<" and all but Latin-1 beyond ASCII are odd
_KIND[33:127] = _SIGN
_KIND[[39, 60]] = _ODD
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[32, 9, 10, 11, 12, 13]] = _SPACE
OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


class Encoder:
    """Ids of whole texts for a tokenizer whose normaliser lower-cases and whose pieces hold no white space.

    Texts are cut at white space. A chunk of ASCII and Latin-1 letters, digits and plain signs is lower-cased and cut
    where the tokenizer's own pattern cuts (runs of letters, single digits, runs of signs); any other chunk, and any
    with an apostrophe or "<" (contractions, special tokens), is left as it is. Each distinct piece is encoded once by
    the tokenizer and found again by its hash: in a table with a slot for the first bits of a hash, which the piece that
    was learnt last has, or else among the sorted hashes. Tests hold the ids against encoding whole texts.
    """

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(self.tokenizer.get_vocab_size())])
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.place = np.zeros(0, np.int64)
        self.hashes = np.zeros(0, np.uint64)  # by place
        self.table = np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint16 if len(self.ends) < 1 << 16 else np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _encoded(self, plain: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of the plain pieces, many to a call, and then of the odd ones."""
        groups = [plain[k : k + 500] for k in range(0, len(plain), 500)]
        got, counts = [], []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int64)
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(group):  # a piece that is not one word of the tokenizer
                one = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
                ids, n = np.array([i for x in one for i in x], np.int64), [len(x) for x in one]
            else:
                n = np.diff(last, prepend=-1)
            got.append(ids)
            counts.append(np.asarray(n, np.int64))
        one = [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)] if odd else []
        got.append(np.array([i for x in one for i in x], np.int64))
        counts.append(np.array([len(x) for x in one], np.int64))
        return np.concatenate(got), np.concatenate(counts)

    def _learn(self, keys: np.ndarray, spans: list[bytes], odd: np.ndarray) -> None:
        order = np.argsort(odd, kind="stable")
        plain = len(order) - int(odd.sum())
        text = [spans[i].decode() for i in order]
        ids, counts = self._encoded(text[:plain], text[plain:])
        used, chunks = int(self.starts[-1]), len(self.starts) - 1
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), self.ids.dtype)])
        self.ids[used : used + len(ids)] = ids
        self.starts = np.concatenate([self.starts, used + np.cumsum(counts)])
        place = np.empty(len(order), np.int64)
        place[order] = chunks + np.arange(len(order))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.place = np.insert(self.keys, at, keys), np.insert(self.place, at, place)
        self.hashes = np.concatenate([self.hashes, keys[order]])
        self.table[(keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = place

    def __call__(self, buf: np.ndarray, offsets: np.ndarray, bounds: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text. bounds: starts and ends of all words, where they are known."""
        if len(self.keys) > CACHE:
            self.clear()
        starts, ends = bounds or word_bounds(buf, offsets)
        kind = _KIND[buf]
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        lead = lead[(buf[lead + 1] != 0x97) & (buf[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTER
        low = LOWER[buf]
        low[lead[buf[lead + 1] < 0x9F] + 1] += 32
        odd = np.zeros(len(starts), bool)
        odd[np.searchsorted(starts, np.flatnonzero(kind == _ODD), "right") - 1] = True
        inside = ragged(starts[odd], ends[odd] - starts[odd])
        low[inside] = buf[inside]
        cut = np.zeros(len(buf), bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        cut[1:] |= kind[1:] == _DIGIT
        cut &= kind != _SPACE
        cut[inside] = False
        heads = np.zeros(len(buf), bool)
        heads[starts] = True
        cut |= heads
        first = np.flatnonzero(cut)
        chunk = np.cumsum(heads[first]) - 1
        last = np.minimum(np.append(first[1:], len(buf)), ends[chunk])
        hashes = span_hashes(low, first, last)
        place = self.table[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        rest = np.flatnonzero(self.hashes[place] != hashes) if len(self.hashes) else np.arange(len(hashes))
        if len(rest):
            keys, example, which = np.unique(hashes[rest], return_index=True, return_inverse=True)
            at = np.searchsorted(self.keys, keys)
            known = at < len(self.keys)
            known[known] = self.keys[at[known]] == keys[known]
            if not known.all():
                some = rest[example[~known]]
                data = low.tobytes()
                self._learn(keys[~known], [data[a:b] for a, b in zip(first[some].tolist(), last[some].tolist(), strict=True)], odd[chunk[some]])
                at = np.searchsorted(self.keys, keys)
            place[rest] = self.place[at][which]
        lengths = self.starts[place + 1] - self.starts[place]
        ids = self.ids[ragged(self.starts[place], lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return ids, np.diff(total[np.searchsorted(first, offsets)])


_KEPT: dict[str, Encoder] = {}


def encoder(tokenizer_path: str) -> Encoder:
    """The Encoder of this process: Spark gives a worker one task after another, and the later ones know the pieces."""
    if tokenizer_path not in _KEPT:
        _KEPT.clear()
        _KEPT[tokenizer_path] = Encoder(tokenizer_path)
    return _KEPT[tokenizer_path]


def pieces(n: int, most: int = MOST) -> list[int]:
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, *, most: int = MOST, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """One row per sequence: doc_id, start, length, ids (array), ids_crc32, doc_tokens, sequence_id, offset, bucket.

    docs: (doc_id, text). A null or empty text has the end id only. Rows that repeat a doc_id are documents of their
    own; a null doc_id stays null. Texts of any length are encoded whole. sequence_id is the input partition, the
    bucket and a running number there; a retried task gives the same. No shuffle.
    """
    tune(docs.sparkSession)
    bits = most.bit_length() - 1
    if most != 1 << bits:
        raise ValueError("most must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        encode, part = Encoder(tokenizer_path), TaskContext.get().partitionId()
        numbers = [0] * (bits + 1)
        for batch in small(batches):
            ids, counts = encode(*flat(batch.column("text")))
            rows, whole_ids, at = [], [], 0
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                whole = np.append(ids[at : at + n], np.uint32(end_id)).astype("<u4")
                at, start = at + n, 0
                for length in pieces(n + 1, most):
                    own, b = whole[start : start + length], length.bit_length() - 1
                    rows.append((doc_id, start, length, zlib.crc32(own.tobytes()), n + 1, part << 36 | b << 32 | numbers[b], 0, b))
                    numbers[b] += 1
                    start += length
                if with_ids:
                    whole_ids.append(whole)
            cols = [pa.array(c, pa.int32() if k == 7 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))] if rows else [pa.array([], pa.int32() if k == 7 else pa.int64()) for k in range(8)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                every = np.concatenate(whole_ids).astype(np.int32) if whole_ids else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(np.cumsum([0] + [r[2] for r in rows], dtype=np.int32), pa.array(every)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT + (", ids array<int>" if with_ids else ""))


def batches(sequences: DataFrame, tokens: int = 1 << 19) -> DataFrame:
    """Adds batch: sequences of one bucket whose lengths add up to about `tokens`, by a hash of sequence_id.

    The number of batches of a bucket follows its count; a batch is a label only, so nothing is gathered in a task.
    """
    counts = sequences.groupBy("bucket").agg(F.count("*").alias("n"))
    number = F.greatest(F.lit(1), F.ceil(F.col("n") * F.pow(F.lit(2), F.col("bucket")) / F.lit(tokens))).cast("long")
    return sequences.join(F.broadcast(counts), "bucket").withColumn("batch", F.pmod(F.xxhash64("sequence_id"), number)).drop("n")


def op2_packing(spark, sf_dir):
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and bucket) of every piece of every document.

    Null and empty texts are one piece with the end id; repeated rows and null ids as in `pack`.
    """
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
