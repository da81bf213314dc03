"""Language identification by interpolated Kneser-Ney character models.

A word is predicted character by character from the four symbols before it, word ends included; contexts do not cross
words, so a text's cross-entropy is a sum over its words and is computed once per distinct word and distinct n-gram.
Each language has, for every order, sorted hash arrays of n-grams (with interpolated probabilities) and of contexts
(with back-off weights). The language of the lowest cross-entropy per symbol wins. Its cross-entropy is accepted up to
a limit calibrated on training documents of that language, scored by models that had not seen them.

N-gram counts come from all training rows, and the models keep every n-gram: a rare language stands beside large ones
as it would alone, and discounts and continuation counts are of whole counts. So the models grow with the distinct
n-grams of the training rows, and so does what the driver builds and every worker holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, ragged, table, tune
from .flat import LOWER, flat, small, span_hashes

ORDER = 5
PAD, END = 2, 3
LEFT_OUT = 8  # one training row in so many, by a hash, is left out of the models that limits are calibrated with
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def _words(buf: np.ndarray, offsets: np.ndarray):
    """Distinct lower-case runs of letters (here: ASCII letters and all beyond ASCII); for each run its word and text."""
    solid = _LETTER[buf]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    start[edge], end[edge - 1] = solid[edge], solid[edge - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    low = LOWER[buf]
    _, example, which = np.unique(span_hashes(low, first, last), return_index=True, return_inverse=True)
    data = low.tobytes()
    words = [data[a:b].decode().lower() for a, b in zip(first[example].tolist(), last[example].tolist(), strict=True)]
    return words, which, np.searchsorted(offsets, first, "right") - 1


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (n, ORDER) of the n-grams of all words, and the number of n-grams of each word."""
    pad, end = chr(PAD) * (ORDER - 1), chr(END)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    points = np.frombuffer("".join([f"{pad}{w}{end}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(lengths + ORDER - 1)
    first = ragged(ends - lengths - ORDER + 1, lengths)
    return points[first[:, None] + np.arange(ORDER)], lengths


def _chain(symbols: np.ndarray) -> list[np.ndarray]:
    """Hash of the last 1, 2, ... symbols of each row."""
    out, h = [], np.full(len(symbols), 0x51ED270B, np.uint64)
    for k in range(symbols.shape[1] - 1, -1, -1):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + symbols[:, k].astype(np.uint64) + np.uint64(1))
        out.append(h)
    return out


def _sorted(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


class KneserNey:
    """One language's model, from its n-grams of the highest order and their counts."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.floor = 1.0 / (len(np.unique(symbols[:, -1])) + 1)
        levels = [(symbols, counts.astype(np.float64))]
        for _ in range(ORDER - 1):  # lower orders count the distinct symbols that come before
            last = levels[0][0][:, 1:]
            _, example, number = np.unique(_chain(last)[-1], return_index=True, return_counts=True)
            levels.insert(0, (last[example], number.astype(np.float64)))
        self.grams, self.contexts = [], []
        for k, (sym, n) in enumerate(levels):
            ones, twos = float((n == 1).sum()), float((n == 2).sum())
            discount = min(max(ones / (ones + 2 * twos), 0.1), 0.9) if ones else 0.5
            context = _chain(sym[:, :-1])[-1] if k else np.zeros(len(sym), np.uint64)
            keys, of = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(of, n), np.bincount(of)
            weight = discount * kinds / total
            lower = self.probability(sym, k) if k else np.full(len(sym), self.floor)
            p = np.maximum(n - discount, 0) / total[of] + weight[of] * lower
            self.grams.append(_sorted(_chain(sym)[-1], p))
            self.contexts.append((keys, weight))

    def probability(self, symbols: np.ndarray, orders: int = ORDER) -> np.ndarray:
        gram, context = _chain(symbols), _chain(symbols[:, :-1])
        p = np.full(len(symbols), self.floor)
        for k in range(orders):
            seen, weight = _find(*self.contexts[k], context[k - 1] if k else np.zeros(len(symbols), np.uint64))
            known, own = _find(*self.grams[k], gram[k])
            p = np.where(known, own, np.where(seen, weight * p, p))
        return p


class Scorer:
    """Cross-entropies (bits a symbol) of texts under each language's model; n-grams seen are held."""

    def __init__(self, models: list[KneserNey]):
        self.models = models
        self.clear()

    def clear(self) -> None:
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros((0, len(self.models)), np.float32)

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        words, which, text = _words(buf, offsets)
        if not words:
            return np.zeros((n, len(self.models))), np.zeros(n, np.int64)
        symbols, lengths = _grams(words)
        keys, example, of = np.unique(_chain(symbols)[-1], return_index=True, return_inverse=True)
        if len(self.keys) > 1_000_000:
            self.clear()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        if not known.all():
            new = symbols[example[~known]]
            bits = np.stack([-np.log2(m.probability(new)) for m in self.models], 1).astype(np.float32)
            self.keys, self.bits = np.insert(self.keys, at[~known], keys[~known]), np.insert(self.bits, at[~known], bits, 0)
            at = np.searchsorted(self.keys, keys)
        edges = np.cumsum(lengths) - lengths
        total, number = np.zeros((n, len(self.models))), np.bincount(text, lengths[which], minlength=n)
        for k in range(len(self.models)):
            word_bits = np.add.reduceat(self.bits[at, k].astype(np.float64)[of], edges)
            total[:, k] = np.bincount(text, word_bits[which], minlength=n)
        return total / np.maximum(number, 1)[:, None], number.astype(np.int64)


def gram_counts(rows: DataFrame) -> DataFrame:
    """lang, gram, n, kept over all texts of rows(lang, text, left), summed in each task first; kept: without rows left out."""

    def run(batches):
        held: dict[tuple[str, bool], list] = {}

        def merged(parts):
            symbols, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            _, example, of = np.unique(_chain(symbols)[-1], return_index=True, return_inverse=True)
            return symbols[example], np.bincount(of, n)

        for batch in small(batches, most=1 << 22):
            langs = batch.column("lang").dictionary_encode()
            for k, lang, left in ((k, lang, left) for k, lang in enumerate(langs.dictionary.to_pylist()) for left in (False, True)):
                mask = pa.compute.and_(pa.compute.equal(langs.indices, k), pa.compute.equal(batch.column("left"), left))
                words, which, _ = _words(*flat(batch.column("text").filter(mask)))
                if words:
                    symbols, lengths = _grams(words)
                    parts = held.setdefault((lang, left), [])
                    parts.append(merged([(symbols, np.repeat(np.bincount(which, minlength=len(words)), lengths).astype(np.float64))]))
                    if len(parts) > 7:
                        parts[:] = [merged(parts)]
        for (lang, left), parts in held.items():
            symbols, n = merged(parts)
            for a in range(0, len(n), 100_000):
                grams = np.ascontiguousarray(symbols[a : a + 100_000]).view(f"<U{ORDER}")[:, 0]
                m = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(grams.tolist(), pa.string()), pa.array(n[a : a + m].astype(np.int64)), pa.array((n[a : a + m] * (not left)).astype(np.int64))], ["lang", "gram", "n", "kept"])

    return rows.mapInArrow(run, "lang string, gram string, n long, kept long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))


def _counted(rows: DataFrame) -> pa.Table:
    """The counts of all n-grams of all rows(lang, text, left); what the driver holds grows with the distinct n-grams."""
    return materialise(gram_counts(rows.where("lang IS NOT NULL AND text IS NOT NULL"))).toArrow()


def _models(counts: pa.Table, column: str) -> tuple[list[str], list[KneserNey]]:
    """Languages (by code point) and their models, from the counts in one column that are not 0."""
    counts = counts.filter(pa.compute.greater(counts.column(column), 0)).combine_chunks()
    names = sorted(pa.compute.unique(counts.column("lang")).to_pylist())
    models = []
    for name in names:
        own = counts.filter(pa.compute.equal(counts.column("lang"), name))
        points = pa.compute.binary_join(pa.array([own.column("gram").to_pylist()], pa.list_(pa.string())), "")[0].as_py()
        models.append(KneserNey(np.frombuffer(points.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER), own.column(column).to_numpy()))
    return names, models


def train(rows: DataFrame) -> tuple[list[str], list[KneserNey]]:
    """Languages (by code point) and their models, from all n-grams of all rows(lang, text) whose lang and text are not null.

    Repeated rows count each time; texts without letters have no n-grams, and a language of such texts has no model.
    Further columns are ignored; an empty table gives no languages.
    """
    return _models(_counted(rows.select("lang", "text", F.lit(False).alias("left"))), "n")


def identify(docs: DataFrame, training: DataFrame, *, slack: float = 1.25, quantile: float = 0.999, short: float = 8.0, columns: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy, accepted (and `columns`) for each row of docs(doc_id, text), repeated rows included.

    training: (doc_id, text, lang). A text that is null or has no letter is `und` with score 0 and is not accepted.
    A letter is a character of Unicode's letter categories, so digits in other forms (one half, superscripts) are none.
    score is the winner's share of the likelihoods at the length of 16 symbols at most; ties go to the language first
    by code point. A text of n symbols is accepted if its cross-entropy is at most `slack` times the given quantile over
    the training documents left out of the models for this (to 0.0001 bits), plus `short` / sqrt(n). With nothing to
    learn from, every text is `und`; an empty docs gives an empty result. Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    tune(spark)
    training = training.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), (F.pmod(F.xxhash64("doc_id", "text"), F.lit(LEFT_OUT)) == 0).alias("left")).where("lang IS NOT NULL")
    counts = _counted(training)
    names, models = _models(counts, "n")
    others, rest = _models(counts, "kept")
    del counts
    shared = spark.sparkContext.broadcast((names, models))  # all n-grams; grows with the distinct ones
    partly = spark.sparkContext.broadcast((others, rest))
    out = "doc_id long, lang_pred string, score double, cross_entropy double, n_symbols long"

    def scored(batches, held=shared):
        names, models = held.value
        scorer = Scorer(models)
        for batch in small(batches):
            bits, number = scorer(*flat(batch.column("text"))) if names else (None, np.zeros(batch.num_rows, np.int64))
            if len(names):
                best = bits.argmin(1)
                low = bits[np.arange(len(best)), best]
                share = 1 / np.exp2((low[:, None] - bits) * np.minimum(number, 16)[:, None]).sum(1)
            texts = batch.column("text")
            pred, score, entropy = [], [], []
            for i in range(len(number)):
                ok = len(names) and number[i] > 0 and any(map(str.isalpha, texts[i].as_py() or ""))
                pred.append(names[best[i]] if ok else "und")
                score.append(float(share[i]) if ok else 0.0)
                entropy.append(float(low[i]) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(number), *(batch.column(c) for c in batch.schema.names[2:])], ["doc_id", "lang_pred", "score", "cross_entropy", "n_symbols", *batch.schema.names[2:]])

    def limits_of(rows, run):
        own = rows.select(F.lit(0).cast("long").alias("doc_id"), "text", "lang").mapInArrow(run, f"{out}, lang string").where("lang = lang_pred")
        own = own.groupBy("lang_pred", F.round("cross_entropy", 4).alias("bits")).agg(F.count("*").alias("n"))  # bounds the distinct values of a language
        return dict(own.groupBy("lang_pred").agg(F.percentile("bits", F.lit(quantile), F.col("n"))).collect())

    limits = limits_of(training.where("left"), lambda batches: scored(batches, partly)) if others else {}
    partly.unpersist()
    few = [n for n in names if limits.get(n) is None]  # languages of which no row was left out: by their own rows
    if few:
        limits |= limits_of(training.where(F.col("lang").isin(few)), scored)
    most = max((v for v in limits.values() if v is not None), default=float("inf"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_{c}") for c in columns))
    kept = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.select(*(f"_{c}" for c in columns)).schema)
    rows = rows.mapInArrow(scored, out + kept)
    limit = F.lit(most * slack)
    for name in names:
        limit = F.when(F.col("lang_pred") == name, F.lit(limits.get(name, most) * slack)).otherwise(limit)
    return rows.withColumn("accepted", F.coalesce(F.col("cross_entropy") <= limit + F.lit(short) / F.sqrt("n_symbols"), F.lit(False))).withColumnsRenamed({f"_{c}": c for c in columns})


def fold_of(column: str, folds: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def op4_language(spark, sf_dir):
    """doc_id, held_out, lang_pred, score (and cross_entropy, accepted) of every document; a null doc_id is not held out.

    Null texts and texts without a letter are `und` with score 0; repeated rows are scored each; see identify.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    got = identify(docs, docs.where(~F.coalesce(held_out, F.lit(False))))
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")
