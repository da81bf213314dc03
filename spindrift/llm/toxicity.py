"""Toxicity by a weighted lexicon.

Texts are folded (lower case, homoglyphs, digits and signs that stand for letters) and matched by Aho-Corasick; hits
count at the start of a word, whole words or stems as the entry says, and not inside an exception phrase. The lexicon
and its weights are log odds of labelled documents: an entry must be so much more frequent in toxic ones that chance
would make less than one such entry, and of entries that begin alike the one that tells most is kept, the longest where
several tell as much. Phrases of two words that hold an entry and are about as rare in toxic documents as other words
are learnt as exceptions, beside those that the caller gives. A logistic function of the summed weights, plain and by
length, gives the score. It is fitted on labelled documents that did not make the lexicon.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, tune
from .flat import small
from .language import fold_of

MAX_LABELLED = 40_000  # labelled documents used for fitting, the first by a hash of doc_id
STEMS = range(4, 9)
# Characters that stand for a letter.
STANDS_FOR = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "ı": "i",
    "\u200b": "", "\u200c": "", "\u200d": "", "\u2060": "", "\ufeff": "", "\u00ad": "", "\u0307": "",
}
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "stupid simple", "idiot proof")
_FOLD = str.maketrans(STANDS_FOR | {chr(0xFF41 + k): chr(97 + k) for k in range(26)})
_WORD = re.compile(r"[^\W_]+")


def folded(text: str) -> str:
    return text.lower().translate(_FOLD)


def pairs(text: str) -> set[tuple[str, str]]:
    """Neighbouring words of a folded text with one blank between them."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    return {(text[a:b], text[c:d]) for (a, b), (c, d) in zip(at, at[1:], strict=False) if text[b:c] == " "}


def candidates(text: str) -> set[str]:
    """Entries that occur in a folded text: whole words (marked by a blank at the end) and stems."""
    words = set(_WORD.findall(text))
    return {f"{w} " for w in words if len(w) > 2} | {w[:n] for w in words for n in STEMS if len(w) > n}


class Matcher:
    """Weights and word counts of texts under a lexicon of entry -> weight."""

    def __init__(self, lexicon: dict[str, float], exceptions=EXCEPTIONS):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for entry, weight in lexicon.items():
            term = entry.strip()
            old = self.auto.get(term, None)
            whole, stem = old[1:3] if old else (0.0, 0.0)
            self.auto.add_word(term, (len(term), weight, stem, False) if entry.endswith(" ") else (len(term), whole, weight, False))
        for phrase in exceptions:
            self.auto.add_word(phrase, (len(phrase), *((self.auto.get(phrase, None) or (0, 0.0, 0.0))[1:3]), True))
        self.some = len(self.auto) > 0
        if self.some:
            self.auto.make_automaton()

    def __call__(self, text: str) -> tuple[float, float, float, float]:
        """Sum of the hits' weights, that by the square root of the words, the largest weight, and hits."""
        text = folded(text)
        best: dict[int, tuple[float, int]] = {}  # one hit a word: the heaviest
        spared = []
        if self.some:
            for last, (size, whole, stem, exception) in self.auto.iter(text):
                start, after = last - size + 1, text[last + 1 : last + 2]
                if start and text[start - 1].isalnum():
                    continue
                ends = not after.isalnum()
                if exception and ends:
                    spared.append((start, last))
                weight = max(whole, stem) if ends else stem
                if weight and weight > best.get(start, (0.0, 0))[0]:
                    best[start] = (weight, last)
        merged: list[list[int]] = []  # spared spans, those that touch as one each
        for a, b in sorted(spared):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        starts = [a for a, _ in merged]
        spare = lambda at, end: (k := bisect.bisect_right(starts, at)) > 0 and end <= merged[k - 1][1]
        hits = [w for s, (w, e) in best.items() if not spare(s, e)]
        words = text.count(" ") + text.count("\n") + 1
        total = sum(hits)
        return total, total / math.sqrt(words), max(hits, default=0.0), float(len(hits))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights (last: constant) of a ridge logistic regression on scaled columns, and the scale."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    a = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * np.append(w[:-1], 0) * len(y) / 100
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.eye(len(w)) * ridge * len(y) / 100
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w, mean, scale


def _chance(bad, n, share: float):
    """How unlikely it is, in nats, that of n documents at least `bad` are toxic where `share` of all are (Chernoff's bound)."""
    rate = bad / n
    part = lambda r, q: F.when(r > 0, r * F.log(r / q)).otherwise(F.lit(0.0))
    return F.when(rate > share, n * (part(rate, F.lit(share)) + part(1 - rate, F.lit(1 - share)))).otherwise(F.lit(0.0))


def _counted(rows: DataFrame, of) -> DataFrame:
    """entry, bad, ok: toxic and other documents of rows(text, toxic) in whose folded text of() finds the entry."""

    def run(batches):
        bad, ok = Counter(), Counter()
        for batch in small(batches):
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (bad if toxic else ok).update(of(folded(text or "")))
        names = list(bad.keys() | ok.keys())
        for at in range(0, len(names), 50_000):
            some = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([bad[t] for t in some], pa.int64()), pa.array([ok[t] for t in some], pa.int64())], ["entry", "bad", "ok"])

    return rows.mapInArrow(run, "entry string, bad long, ok long").groupBy("entry").agg(F.sum("bad").alias("bad"), F.sum("ok").alias("ok"))


def learn_lexicon(rows: DataFrame, *, least: int = 3, odds: float = 2.0) -> dict[str, float]:
    """Entries that toxic documents of rows(text, toxic) hold far more often than others, with their log odds.

    Null and empty texts hold no entry; a text of any length counts once for each entry. Repeated rows count each time.
    An entry is left out if one that begins like it, or that it begins with, is kept. With labels of one kind, or an
    empty table, the lexicon is empty. What the driver gets is bounded by the labelled sample that rows are.
    """
    totals = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    bad_all, ok_all = totals.get(1, 0), totals.get(0, 0)
    if not bad_all or not ok_all:
        return {}
    counts = _counted(rows, candidates).where(F.col("bad") >= least).persist()
    number = max(counts.count(), 1)
    weight = F.log((F.col("bad") + 0.5) / F.lit(bad_all + 1.0)) - F.log((F.col("ok") + 0.5) / F.lit(ok_all + 1.0))
    rare = _chance(F.col("bad"), F.col("bad") + F.col("ok"), bad_all / (bad_all + ok_all))
    top = counts.withColumn("w", weight).withColumn("rare", rare).where((F.col("w") >= odds) & (F.col("rare") > math.log(number))).collect()
    counts.unpersist()
    out: dict[str, float] = {}
    stems: set[str] = set()  # beginnings of kept entries, and the kept ones whole
    for r in sorted(top, key=lambda r: (-round(r["rare"], 6), -len(r["entry"]), r["entry"])):
        term = r["entry"].strip()
        begins = {term[:n] for n in range(1, len(term) + 1)}
        if r["entry"] in stems or term in stems or any(e in out for e in begins):
            continue
        out[r["entry"]] = r["w"]
        stems |= begins
    return out


def learn_exceptions(rows: DataFrame, lexicon: dict[str, float], *, least: int = 3) -> tuple[str, ...]:
    """Phrases of two words, one of them a hit, that documents of rows(text, toxic) hold without being toxic.

    A phrase is one if it is in `least` documents that are not toxic, makes up most of them where it occurs, and is so
    much rarer in toxic ones than the hit alone that chance does not explain it.
    """
    if not lexicon:
        return ()
    match = Matcher(lexicon, ())

    def held(text):
        return {f"{a} {b}" for a, b in pairs(text) if match(a)[3] or match(b)[3]}

    counts = _counted(rows, held).where((F.col("ok") >= least) & (F.col("ok") > 4 * F.col("bad")))
    return tuple(sorted(r["entry"] for r in counts.collect()))


def score(docs: DataFrame, labelled: DataFrame, *, max_labelled: int = MAX_LABELLED, exceptions: tuple[str, ...] = EXCEPTIONS) -> DataFrame:
    """doc_id, score, predicted, hits for each row of docs(doc_id, text), repeated rows included.

    labelled: (doc_id, toxic); of repeated ids the largest label counts, null ids and labels are left out. The model is
    fitted on at most `max_labelled` of them, the first by a hash, with one text each. exceptions: phrases that excuse
    the hits inside them, beside those that are learnt. A null or empty text is scored like one without
    hits. With no labels of either kind every score is 0.
    """
    tune(docs.sparkSession)
    labels = labelled.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = F.broadcast(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = texts.join(labels, "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # one text an id
    known = known.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)))
    made = materialise(known)
    lexicon = learn_lexicon(made.where("half > 0").select("text", "toxic"))
    spared = (*exceptions, *learn_exceptions(made.where("half > 0").select("text", "toxic"), lexicon))

    def matched(batches):
        match = Matcher(lexicon, spared)
        for batch in small(batches):
            values = [match(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(values, pa.list_(pa.float64()))], ["toxic", "x"])

    fit = made.where("half = 0").select("text", "toxic").mapInArrow(matched, "toxic int, x array<double>").toArrow()
    y = np.array(fit.column("toxic").to_pylist(), float)
    x = np.array(fit.column("x").to_pylist(), float).reshape(-1, 4)
    model = _logistic(x, y) if 0 < y.sum() < len(y) else None

    def scored(batches):
        match = Matcher(lexicon, spared)
        for batch in small(batches):
            values = np.array([match(t or "") for t in batch.column("text").to_pylist()], float).reshape(-1, 4)
            if model is None:
                p = np.zeros(len(values))
            else:
                w, mean, scale = model
                p = 1 / (1 + np.exp(-np.clip((values - mean) / scale @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(values[:, 3].astype(np.int64))], ["doc_id", "score", "predicted", "hits"])

    return texts.mapInArrow(scored, "doc_id long, score double, predicted int, hits long")


def op7_toxicity(spark, sf_dir):
    """doc_id, held_out, score, predicted (and hits) of every document; a null doc_id is not held out. See score."""
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    got = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out))
    return got.select("doc_id", held_out.alias("held_out"), "score", "predicted", "hits")
