"""Scores of texts under a causal self-attention language model over subword ids, trained in numpy, beside a word unigram.

A text is a sequence of a tokenizer's ids and one end. Ids have classes: frequent ids are classes of their own, the others
share classes by frequency, and within a class an id has its share after the class before. The next class is predicted
from the classes before it in a window: one attention head with a learned bias by distance, a hidden layer and an output
layer, whose result multiplies the odds of the class pairs: first of groups of classes, then of a group's members. So
there are three kinds of knowledge: counts of ids after classes, over all training documents; weights, trained in rounds
of steps on all windows of the training documents, the results of which are averaged; and, for the unigram, counts of all
training words.

Odds of outputs and weights of attention are powers of 2, which numpy computes sooner than those of e.

Texts are encoded once, into blocks of about 8 MB of text: a row with the ids, the block's distinct words and their
places. Words meet by hash, a block's distinct words once; the counts go back to the block, so that a frequent word is
one entry a block and not one a document. What the driver holds is bounded by the vocabulary and the model's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import groups_of, materialise, ragged, runs, table, tune
from .flat import LOWER, distinct, flat, small, span_hashes, word_bounds
from .language import fold_of
from .packing import encoder

BLOCK_TEXT = 1 << 23
CLASSES, SHARED = 320, 64  # of all classes so many are shared by rarer ids; class 0 stands before the first id only
WINDOW, STRIDE = 24, 12
SIZE, HIDDEN = 16, 16
GROUPS, MEMBERS = 16, 20  # class y is member y % MEMBERS of group y // MEMBERS
RATES, STEPS, BATCH = (2e-2, 2e-2, 5e-3), 32, (64, 256)  # of each round; fewest steps on a block in a round, and least and most windows in each
FAN = 64
END_WORD = np.uint64(0x5EED_0E4D_0000_0001)  # stands for the end among the hashes of words
PRIOR, CLASS_PRIOR, SHARE_PRIOR = 0.5, 8.0, 5.0
LOG2_E, LN_2 = np.float32(1 / np.log(2)), np.float32(np.log(2))
MOST_OUT, MOST_IN = 30, 60  # exponents of 2 of an output's odds and of an attention weight are held within these


# --- the model ------------------------------------------------------------------------------------------------------


class Classes:
    """Class of each id and the log share of each id in its class, from the training counts of all ids."""

    def __init__(self, counts: np.ndarray, ends: np.ndarray, end_id: int):
        mass = counts + PRIOR
        single = np.lexsort((np.arange(len(counts)), -counts))
        single = np.concatenate([[end_id], single[single != end_id]])[: CLASSES - SHARED - 1]
        rest = np.ones(len(counts), bool)
        rest[single] = False
        rest = np.flatnonzero(rest)
        rest = rest[np.lexsort((rest, -counts[rest], ends[rest]))]
        self.of = np.zeros(len(counts), np.uint16)
        self.of[single] = np.arange(1, len(single) + 1)
        share = np.cumsum(mass[rest]) / max(mass[rest].sum(), 1e-9)
        self.of[rest] = CLASSES - SHARED + np.minimum((share * SHARED).astype(np.int64), SHARED - 1)
        self.share = (mass / np.bincount(self.of, mass, CLASSES)[self.of]).astype(np.float32)
        self.end_id, self.end = end_id, int(self.of[end_id])


class After:
    """How often ids come after classes: keys (class before * vocabulary + id, sorted), counts, and the sums by class."""

    def __init__(self, classes: Classes, keys: np.ndarray, counts: np.ndarray):
        size = len(classes.of)
        before, of = keys // size, classes.of[keys % size]
        self.pairs = np.bincount(before * CLASSES + of, counts, CLASSES * CLASSES).reshape(CLASSES, CLASSES)
        several = of >= CLASSES - SHARED
        self.keys, self.counts, self.classes = keys[several], counts[several].astype(np.float32), classes

    def log_shares(self, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of ids within their classes y after classes x; 0 where an id is a class of its own."""
        out = np.zeros(len(ids), np.float32)
        which = np.flatnonzero(y >= CLASSES - SHARED)
        before, of, own = x[which].astype(np.int64), y[which], ids[which]
        n = np.zeros(len(which), np.float32)
        if len(self.keys):
            wanted = before * len(self.classes.of) + own
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            n = np.where(self.keys[at] == wanted, self.counts[at], 0)
        out[which] = np.log((n + SHARE_PRIOR * self.classes.share[own]) / (self.pairs[before, of] + SHARE_PRIOR))
        return out


def odds(r: np.ndarray, bound: float, most: int) -> np.ndarray:
    """2^r, in place. bound: what r cannot exceed; only where that is more than `most`, r is looked at and held."""
    if not bound <= most:
        np.clip(r, -most, most, out=r)
    return np.exp2(r, out=r)


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max()))


def _largest(rows: np.ndarray) -> float:
    return float(max(rows.max(), -rows.min())) if rows.size else 0.0


def class_pairs(pairs: np.ndarray) -> np.ndarray:
    """Probability of a class after a class, from counts of pairs: what was counted, and the classes' own shares as prior."""
    total = pairs.sum(0) + 0.1
    total[0] = 0
    p = (pairs + CLASS_PRIOR * total / total.sum()) / (pairs.sum(1, keepdims=True) + CLASS_PRIOR)
    return np.maximum(p, 1e-30).astype(np.float32)


SHAPES = {"embed": (CLASSES, SIZE), "query": (SIZE, SIZE), "value": (SIZE, SIZE), "near": (WINDOW,), "up": (SIZE, HIDDEN), "bias": (HIDDEN,), "down": (HIDDEN, SIZE), "group": (SIZE, GROUPS), "out": (SIZE, CLASSES)}
_CUTS = np.cumsum([0] + [int(np.prod(s)) for s in SHAPES.values()])
_APART = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]


def parameters(vector: np.ndarray) -> dict[str, np.ndarray]:
    return {k: vector[a:b].reshape(s).astype(np.float32, copy=False) for (k, s), a, b in zip(SHAPES.items(), _CUTS[:-1], _CUTS[1:], strict=True)}


def initial(seed: int = 7) -> np.ndarray:
    """The first weights; the output layer is 0, so that the model begins as the class bigram."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, s[0] ** -0.5 if len(s) > 1 else 0.0, s) for k, s in SHAPES.items()}
    p["embed"] = rng.normal(0, 1.0, SHAPES["embed"])
    p["group"][:] = p["out"][:] = 0
    p["near"] = -0.1 * np.arange(WINDOW)
    return np.concatenate([x.ravel() for x in p.values()])


def _decay(near: np.ndarray) -> np.ndarray:
    """What the distance makes of an attention weight; 0 for what comes later."""
    return np.where(_APART >= 0, np.exp(near[np.maximum(_APART, 0)]), 0).astype(np.float32)


def _priors(pairs: np.ndarray) -> np.ndarray:
    """Row x * GROUPS + g: shares of the groups after class x, then those of the members of g among themselves."""
    by = pairs.reshape(CLASSES, GROUPS, MEMBERS)
    groups = by.sum(2, keepdims=True)
    every = np.broadcast_to(groups.reshape(CLASSES, 1, GROUPS), (CLASSES, GROUPS, GROUPS))
    return np.concatenate([every, by / groups], 2).reshape(-1, GROUPS + MEMBERS).astype(np.float32)


def _layers(p: dict[str, np.ndarray]) -> np.ndarray:
    """The output layer for targets in each group: the columns of the groups, then those of the group's members."""
    out = np.empty((GROUPS, SIZE, GROUPS + MEMBERS), np.float32)
    out[:, :, :GROUPS], out[:, :, GROUPS:] = p["group"], p["out"].reshape(SIZE, GROUPS, MEMBERS).transpose(1, 0, 2)
    return out


_GROUP, _MEMBER = (np.arange(CLASSES) // MEMBERS).astype(np.uint8), np.arange(CLASSES) % MEMBERS


def _by_group(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """An order of rows by the group of y, and each group with its bounds in it; in that order, the rows of priors and
    where y's group and y itself are among all numbers of the output layer.
    """
    of = _GROUP.take(y)
    counts = np.bincount(of, minlength=GROUPS)
    bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
    order = np.argsort(of, kind="stable")
    own, at = np.repeat(np.arange(GROUPS), counts), np.arange(0, len(y) * (GROUPS + MEMBERS), GROUPS + MEMBERS)
    prior = x.take(order).astype(np.int64)
    prior *= GROUPS
    prior += own
    own += at
    at += GROUPS
    at += _MEMBER.take(y.take(order))
    return order, list(zip(range(GROUPS), bounds[:-1], bounds[1:], strict=True)), prior, (own, at)


# products with these sum rows, into one column for each part or into all columns: numpy is slow along short rows
_PARTS = np.repeat(np.eye(2, dtype=np.float32), [GROUPS, MEMBERS], axis=0)
_WHOLE, _TOTAL = np.ones(WINDOW, np.float32), np.ones((SIZE, 1), np.float32)
_SAME = np.eye(WINDOW, dtype=np.float32)  # numpy turns small arrays faster by a product than by a copy


def _crossed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b for many rows, some at a time: long columns pass a core's cache by."""
    at, some = len(a) // 512 * 512, lambda t: t[: len(t) // 512 * 512].reshape(-1, 512, t.shape[1])
    return (some(a).transpose(0, 2, 1) @ some(b)).sum(0) + a[at:].T @ b[at:]


def _class_sums(rows: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of rows by their classes."""
    width = rows.shape[1]
    place = np.arange(CLASSES * width).reshape(CLASSES, width).take(of, 0)
    return np.bincount(place.ravel(), rows.ravel(), CLASSES * width).reshape(CLASSES, width).astype(np.float32)


class Model:
    """Windows under fixed weights. What depends on a class alone is a table."""

    def __init__(self, vector: np.ndarray, pairs: np.ndarray):
        p = parameters(vector)
        self.embed, self.up, self.bias, self.down, self.priors = p["embed"], p["up"], p["bias"], p["down"], _priors(pairs)
        self.out = _layers(p) * LOG2_E
        self.query = p["embed"] @ p["query"] * np.float32(SIZE**-0.5 * LOG2_E)
        self.value, self.decay = p["embed"] @ p["value"], _decay(p["near"])
        self.bound, self.steepest = _longest(self.query) * _longest(self.embed), float(np.abs(self.out).sum(1).max())

    def states(self, x: np.ndarray) -> np.ndarray:
        """x: (windows, WINDOW) classes; the result is what the output layer reads at all positions, a row each."""
        return self._mixed(x, self.embed.take(x, 0), self.value.take(x, 0))

    def later_states(self, x: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """The same for overlapping windows that begin at each STRIDE of x, at the positions that the one before lacks.

        heads: windows of which the first WINDOW - STRIDE positions do not count.
        """
        windows = lambda t: np.lib.stride_tricks.sliding_window_view(t.take(x, 0), WINDOW, 0)[::STRIDE].transpose(0, 2, 1)
        return self._mixed(x[WINDOW - STRIDE :].reshape(-1, STRIDE), windows(self.embed), windows(self.value), heads)

    def _mixed(self, last: np.ndarray, keys: np.ndarray, values: np.ndarray, heads=()) -> np.ndarray:
        s = odds(self.query.take(last, 0) @ keys.transpose(0, 2, 1), self.bound, MOST_IN)
        s *= self.decay[-last.shape[1] :]
        if len(heads):
            s[heads, :, : WINDOW - STRIDE] = 0
        z = (s @ values).reshape(-1, SIZE)
        z *= 1 / (s @ _WHOLE).reshape(-1, 1)
        z += self.embed.take(last.ravel(), 0)
        h = z @ self.up
        h += self.bias
        np.maximum(h, 0, out=h)
        z += h @ self.down
        return z

    def log_probs(self, z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of class y after class x with state z, for each row: the log of its group's probability and of its own there."""
        order, groups, prior, hits = _by_group(x, y)
        z, out = z.take(order, 0), np.empty((len(z), GROUPS + MEMBERS), np.float32)
        for g, a, b in groups:
            np.matmul(z[a:b], self.out[g], out=out[a:b])
        odds(out, _largest(z) * self.steepest, MOST_OUT)
        out *= self.priors.take(prior, 0)
        sums = np.log(out @ _PARTS)
        got = np.empty(len(z), np.float32)
        got[order] = sum(np.log(out.ravel().take(hit)) - sums[:, k] for k, hit in enumerate(hits))
        return got


class Trainer:
    """Steps of Adam on windows, all of whose positions are targets but for those that are padding."""

    def __init__(self, vector: np.ndarray, pairs: np.ndarray, rate: float = RATES[0]):
        self.vector, self.priors, self.rate = vector.astype(np.float32), _priors(pairs), rate
        self.m, self.v, self.steps = np.zeros_like(self.vector), np.zeros_like(self.vector), 0

    def gradient(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean loss and its gradient over the positions that are real.

        What depends on a class alone (its embedding, query, key and value) is a table's row. Where an exponent is held
        (see `odds`), the gradient goes on as if it were not.
        """
        p, near = parameters(self.vector), np.float32(SIZE**-0.5)
        windows, flat_x, flat_y, n = x.shape[0], x.ravel(), y.ravel(), np.float32(max(int(real.sum()), 1))
        three = lambda t: t.reshape(windows, WINDOW, -1)
        own = p["embed"]
        queries, e = own @ p["query"] * (near * LOG2_E), own.take(flat_x, 0)
        q, before = queries.take(x, 0), np.empty((windows, SIZE + 1, WINDOW), np.float32)
        np.matmul(three(e).transpose(0, 2, 1), _SAME, out=before[:, :SIZE])
        before[:, SIZE] = -1
        a = odds(q @ before[:, :SIZE], _longest(queries) * _longest(own), MOST_IN)
        a *= _decay(p["near"])
        share = 1 / (a @ _WHOLE).reshape(-1, 1)
        mixed = (a @ three(e)).reshape(-1, SIZE)
        mixed *= share
        h = mixed @ p["value"]
        h += e
        act = h @ p["up"]
        act += p["bias"]
        np.maximum(act, 0, out=act)
        z = act @ p["down"]
        z += h
        # the output layer, in an order by the targets' groups
        order, groups, prior, hits = _by_group(flat_x, flat_y)
        layers, u = _layers(p), z.take(order, 0)
        powers = layers * LOG2_E
        d = np.empty((len(u), GROUPS + MEMBERS), np.float32)
        for g, i, j in groups:
            np.matmul(u[i:j], powers[g], out=d[i:j])
        odds(d, _largest(u) * LOG2_E * max(float(np.abs(p[k]).sum(0).max()) for k in ("group", "out")), MOST_OUT)
        d *= self.priors.take(prior, 0)
        weight, total = real.ravel().take(order).astype(np.float32) / n, d @ _PARTS
        loss = -sum(float(np.log(d.ravel().take(hit) / total[:, i]) @ weight) for i, hit in enumerate(hits))
        d *= (weight[:, None] / total) @ _PARTS.T
        for hit in hits:
            d.ravel()[hit] -= weight
        du, both, back = np.empty_like(u), np.empty_like(layers), layers.transpose(0, 2, 1).copy()
        for g, i, j in groups:
            np.matmul(d[i:j], back[g], out=du[i:j])
            np.matmul(u[i:j].T, d[i:j], out=both[g])
        g = {"group": both[:, :, :GROUPS].sum(0), "out": both[:, :, GROUPS:].transpose(1, 0, 2).reshape(SIZE, CLASSES)}
        dz = np.empty_like(du)
        dz[order] = du
        dact = dz @ p["down"].T
        dact *= np.sign(act)
        g["down"], g["up"], g["bias"] = _crossed(act, dz), _crossed(h, dact), np.ones(len(dact), np.float32) @ dact
        dh = dact @ p["up"].T
        dh += dz
        g["value"] = _crossed(mixed, dh)
        # the attention's weights are a / their sum
        dmixed = np.empty((len(dh), SIZE + 1), np.float32)
        inner = dh @ p["value"].T
        inner *= share
        mixed *= inner
        dmixed[:, :SIZE] = inner
        np.matmul(mixed, _TOTAL, out=dmixed[:, SIZE:])
        da = three(dmixed) @ before
        da *= a
        low = _APART >= 0
        g["near"] = np.bincount(_APART[low], da.sum(0)[low], WINDOW)
        dq = (da @ three(e)).reshape(-1, SIZE)
        dq *= near
        dh += dq @ p["query"].T
        dh += (a.transpose(0, 2, 1) @ three(inner)).reshape(-1, SIZE)
        q *= LN_2
        dh += (da.transpose(0, 2, 1) @ q).reshape(-1, SIZE)
        g["embed"], g["query"] = _class_sums(dh, flat_x), _crossed(e, dq)
        return loss, np.concatenate([g[name].ravel() for name in SHAPES]).astype(np.float32)

    def step(self, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> float:
        loss, g = self.gradient(x, y, real)
        self.steps += 1
        self.m += 0.1 * (g - self.m)
        self.v += 0.02 * (g * g - self.v)
        self.vector -= self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.98**self.steps)) + 1e-8)
        return loss


def sequences(classes: Classes, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets (classes) of all texts in a row, and the bounds of each text: its ids and one end."""
    edge = np.concatenate([[0], np.cumsum(counts + 1)])
    y = np.empty(int(edge[-1]), np.uint16)
    inside = np.ones(len(y), bool)
    inside[edge[1:] - 1] = False
    y[inside], y[~inside] = classes.of[ids], classes.end
    x = np.empty_like(y)
    x[1:] = y[:-1]
    x[edge[:-1]] = 0
    return x, y, edge


def text_scores(model: Model, after: After, ids: np.ndarray, counts: np.ndarray, at_once: int = 512) -> np.ndarray:
    """log10 probability of each text. Windows overlap; each position is scored once, where it has the most context.

    The first window of a text scores all its positions, each further one the STRIDE positions that the ones before it
    did not reach. So texts are laid out in steps of STRIDE positions, a step that does not count before each: every step
    is scored after the one before it, in batches of so many steps of all texts.
    """
    x, y, edge = sequences(after.classes, ids, counts)
    steps = -(-(counts + 1) // STRIDE)
    head = np.cumsum(steps + 1) - steps - 1  # the step before each text
    place = ragged((head + 1) * STRIDE, counts + 1)
    spread = np.zeros((2, int((steps + 1).sum()) * STRIDE), np.int64)
    spread[0, place], spread[1, place] = x, y
    logs = np.zeros(spread.shape[1], np.float32)
    for a in range(0, len(logs) // STRIDE - 1, at_once):
        b = min(a + at_once, len(logs) // STRIDE - 1)
        own = slice((a + 1) * STRIDE, (b + 1) * STRIDE)
        heads = head[np.searchsorted(head, a) : np.searchsorted(head, b)] - a
        logs[own] = model.log_probs(model.later_states(spread[0, a * STRIDE : own.stop], heads), spread[0, own], spread[1, own])
    logs = logs[place]
    logs += after.log_shares(x, y, np.insert(ids, np.cumsum(counts), after.classes.end_id))
    return np.add.reduceat(logs.astype(np.float64), edge[:-1]) / np.log(10) if len(counts) else np.zeros(0)


# --- blocks ---------------------------------------------------------------------------------------------------------


def _packed(x: np.ndarray) -> bytes:
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpacked(x, dtype) -> np.ndarray:
    data = x.as_py()
    size = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True) if size else b"", dtype)


BLOCK = "block long, doc_id binary, learns binary, n_words binary, place binary, words binary, counted binary, n_ids binary, ids binary, learnt binary"


def blocks(docs: DataFrame, learns: Column, tokenizer_path: str) -> DataFrame:
    """Rows of about 8 MB of text of docs(doc_id, text), whole texts each: a longer text is a block of its own.

    doc_id, learns: of each text (a null id has its bit in learns); n_words, place: words and end of each text as places
    in words, the sorted hashes of the block's distinct words; counted: how often each stands in texts to learn from;
    n_ids, ids: subword ids; learnt: how often each id stands in texts to learn from. Block numbers come from the partition, so a task that is run again gives the same.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learns, F.lit(False)).alias("learns"))

    def run(batches):
        from pyspark import TaskContext

        encode, number, held, size = encoder(tokenizer_path), TaskContext.get().partitionId() << 32, [], 0

        def block(parts):
            ident, learns, n_words, hashes, n_ids, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
            words, place = distinct(hashes)
            counted = np.bincount(place, np.repeat(learns & 1, n_words).astype(np.float64), len(words)).astype(np.uint32)
            own = np.bincount(ids[np.repeat((learns & 1) > 0, n_ids)]).astype(np.uint32)
            values = [ident, learns, n_words, place.astype(np.uint32), words, counted, n_ids, ids, own]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([_packed(v)], pa.large_binary()).cast(pa.binary()) for v in values)], [c.split()[0] for c in BLOCK.split(", ")])

        for batch in small(batches):
            buf, offsets = flat(batch.column("text"))
            starts, ends = word_bounds(buf, offsets)
            first = np.searchsorted(starts, offsets)
            hashes = np.insert(span_hashes(LOWER[buf], starts, ends), first[1:], END_WORD)
            ids, n_ids = encode(buf, offsets, (starts, ends))
            ident = batch.column("doc_id")
            flags = batch.column("learns").to_numpy(zero_copy_only=False).astype(np.uint8) | (ident.is_null().to_numpy(zero_copy_only=False).astype(np.uint8) << 1)
            held.append((ident.fill_null(0).to_numpy(), flags, (np.diff(first) + 1).astype(np.uint32), hashes, n_ids.astype(np.uint32), ids.astype(np.uint16)))
            size += len(buf)
            if size >= BLOCK_TEXT:
                yield block(held)
                number, held, size = number + 1, [], 0
        if held:
            yield block(held)

    return rows.mapInArrow(run, BLOCK)


def word_counts(stored: DataFrame, bits: int) -> DataFrame:
    """For each block and range of hashes the training counts of the block's words there: block, part, counts.

    Rows without a block have the tokens and distinct words of a range in tokens and kinds.
    """

    def dealt(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                words, counted = _unpacked(batch.column("words")[k], np.uint64), _unpacked(batch.column("counted")[k], np.uint32)
                part = (words >> np.uint64(64 - bits)).astype(np.int64)
                a = runs(part)
                some, b = part[a], np.append(a[1:], len(words))
                cols = [pa.array(some), pa.array(np.full(len(some), batch.column("block")[k].as_py())), *(pa.array([x[i:j].tobytes() for i, j in zip(a.tolist(), b.tolist(), strict=True)], pa.binary()) for x in (words, counted))]
                yield pa.RecordBatch.from_arrays(cols, ["part", "block", "words", "counted"])

    def met(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("words")]
        words, of = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(of, np.frombuffer(b"".join(x.as_py() for x in group.column("counted")), np.uint32).astype(np.float64), len(words)).astype(np.int64)
        edge = np.cumsum([0] + [len(p) for p in parts])
        answers = [_packed(total[of[a:b]]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        n = len(answers)
        return pa.table({
            "block": pa.concat_arrays([group.column("block").combine_chunks(), pa.array([None], pa.int64())]), "part": pa.array([group.column("part")[0].as_py()] * (n + 1), pa.int64()),
            "counts": pa.array([*answers, None], pa.binary()), "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()), "kinds": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
        })

    rows = stored.select("block", "words", "counted").mapInArrow(dealt, "part long, block long, words binary, counted binary")
    return rows.groupBy("part").applyInArrow(met, "block long, part long, counts binary, tokens long, kinds long")


def word_sums(stored: DataFrame, answers: DataFrame) -> DataFrame:
    """block, i, doc_id, learns, n_tokens, n_known, log_sum (of log10 of count + 1) of each text."""

    def met(_, block: pa.Table, replies: pa.Table) -> pa.Table:
        replies = replies.sort_by("part")
        counts = np.concatenate([_unpacked(x, np.int64) for x in replies.column("counts")])
        out = []
        for k in range(block.num_rows):
            ident, flags, n = (_unpacked(block.column(c)[k], t) for c, t in (("doc_id", np.int64), ("learns", np.uint8), ("n_words", np.uint32)))
            own = counts[_unpacked(block.column("place")[k], np.uint32)]
            edge = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[:-1]
            out.append(pa.table({
                "block": pa.array(np.full(len(ident), block.column("block")[k].as_py())), "i": pa.array(np.arange(len(ident))), "doc_id": pa.array(ident, mask=(flags & 2) > 0), "learns": pa.array((flags & 1) > 0),
                "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(np.add.reduceat((own > 0).astype(np.int64), edge)), "log_sum": pa.array(np.add.reduceat(np.log10(own + 1.0), edge)),
            }))
        return pa.concat_tables(out)

    left = stored.select("block", "doc_id", "learns", "n_words", "place").groupBy("block")
    return left.cogroup(answers.where("block IS NOT NULL").select("block", "part", "counts").groupBy("block")).applyInArrow(met, "block long, i long, doc_id long, learns boolean, n_tokens long, n_known long, log_sum double")


# --- sums over all training texts -----------------------------------------------------------------------------------


def summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors of rows(part, v: packed doubles), one a task: FAN at a time, so that the driver gets FAN at most."""
    n = rows.rdd.getNumPartitions()

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        return pa.table({"part": pa.array([group.column("to")[0].as_py()]), "v": pa.array([_packed(sum(_unpacked(v, np.float64) for v in group.column("v")))], pa.binary())})

    while n > FAN:
        n = -(-n // FAN)
        rows = rows.withColumn("to", F.pmod("part", F.lit(n)).cast("long")).groupBy("to").applyInArrow(add, "part long, v binary")
    out = np.zeros(size)
    for v in rows.toArrow().sort_by("part").column("v"):
        out += _unpacked(v, np.float64)
    return out


def learnt(batches):
    """The ids of the texts to learn from, and the number of each text's, block by block."""
    for batch in batches:
        for k in range(batch.num_rows):
            n, flags = _unpacked(batch.column("n_ids")[k], np.uint32).astype(np.int64), _unpacked(batch.column("learns")[k], np.uint8)
            own = (flags & 1) > 0
            yield _unpacked(batch.column("ids")[k], np.uint16)[np.repeat(own, n)].astype(np.int64), n[own]


def over_texts(stored: DataFrame, make) -> DataFrame:
    """One row a task with the vector that make() -> (take(ids, counts), vector()) has after all texts to learn from."""

    def run(batches):
        from pyspark import TaskContext

        take, vector = make()
        for ids, counts in learnt(batches):
            take(ids, counts)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(vector())], pa.binary())], ["part", "v"])

    return stored.select("learns", "n_ids", "ids").mapInArrow(run, "part long, v binary")


def counted_ids(stored: DataFrame, vocabulary: int, end_id: int) -> np.ndarray:
    """How often each id stands in texts to learn from, from the counts of the blocks; an end a text."""

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                own = _unpacked(batch.column("learnt")[k], np.uint32)
                total[: len(own)] += own
                total[end_id] += int((_unpacked(batch.column("learns")[k], np.uint8) & 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(total)], pa.binary())], ["part", "v"])

    return summed(stored.select("learns", "learnt").mapInArrow(run, "part long, v binary"), vocabulary)


def counted_after(stored: DataFrame, shared) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (class before * vocabulary + id) and their counts; at most CLASSES times the vocabulary."""

    def run(batches):
        size, held = len(shared.value.of), []
        alone = np.zeros(CLASSES, np.int64)  # the id of a class that has one
        alone[shared.value.of] = np.arange(size)

        def merged():
            keys, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(of, np.concatenate([n for _, n in held]), len(keys))

        for ids, counts in learnt(batches):
            x, y, _ = sequences(shared.value, ids, counts)
            several = y >= CLASSES - SHARED
            pairs = np.bincount(x[~several].astype(np.int64) * CLASSES + y[~several])  # of ids that are classes of their own
            some = np.flatnonzero(pairs)
            held.append((some // CLASSES * size + alone[some % CLASSES], pairs[some]))
            every = np.insert(ids, np.cumsum(counts), shared.value.end_id)
            held.append(np.unique(x[several].astype(np.int64) * size + every[several], return_counts=True))
            if len(held) > 14:
                held[:] = [merged()]
        if held:
            keys, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    got = stored.select("learns", "n_ids", "ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow().sort_by("key")
    return got.column("key").to_numpy(), got.column("n").to_numpy()


def trained(stored: DataFrame, shared, pairs, vector: np.ndarray, turn: int) -> tuple[np.ndarray, float]:
    """Weights after a round, and the mean loss in it: each task trains on its blocks one after another, and the results are averaged.

    All windows (of all positions of the texts to learn from, without overlap) are trained on: see `turns`. A task counts
    by the positions that it trained on.
    """

    def make():
        trainer, state = Trainer(vector, pairs.value, RATES[turn]), {"positions": 0, "loss": 0.0}

        def take(ids, counts):
            if not len(counts):
                return
            x, y, edge = sequences(shared.value, ids, counts)
            start, n = cut(edge)
            # what follows a text's end in a window is not real, and is not seen by what is before it
            x, y = (np.lib.stride_tricks.sliding_window_view(np.append(t, np.zeros(WINDOW, t.dtype)), WINDOW) for t in (x, y))
            for which in turns(len(start), turn):
                of, positions = start[which], n[which]
                state["loss"] += trainer.step(x[of], y[of], np.arange(WINDOW) < positions[:, None]) * int(positions.sum())
                state["positions"] += int(positions.sum())

        return take, lambda: np.concatenate([trainer.vector.astype(np.float64) * state["positions"], [state["positions"], state["loss"]]])

    got = summed(over_texts(stored, make), len(vector) + 2)
    if not got[-2]:
        return vector, 0.0
    return got[:-2] / got[-2], got[-1] / got[-2]


def cut(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that texts with these bounds are cut into, and how many positions each has."""
    each = -(-np.diff(edge) // WINDOW)
    start = np.repeat(edge[:-1], each) + WINDOW * ragged(np.zeros(len(each), np.int64), each)
    return start, np.minimum(np.repeat(edge[1:], each) - start, WINDOW)


def turns(windows: int, turn: int):
    """The windows of a block for each step of a round. The rounds go through all windows in one order by chance.

    Rounds take 1, 3, 5, ... parts of the order, as the first weights are far apart and are to be averaged soon. A block
    of few windows gives each round STEPS steps of the least size, for which it is gone through several times.
    """
    order = np.random.default_rng(windows).permutation(windows)
    a, b = (windows * k * k // len(RATES) ** 2 for k in (turn, turn + 1))
    size = min(max(-(-(b - a) // STEPS), BATCH[0]), BATCH[1])
    b = max(b, a + STEPS * BATCH[0])
    for k in range(a, b, size):
        yield order[np.arange(k, min(k + size, b)) % windows]


# --- scores ---------------------------------------------------------------------------------------------------------


def scored(docs: DataFrame, learns: Column, tokenizer_path: str) -> DataFrame:
    """doc_id, learns, n_tokens, n_known, train_tokens, base_score, score of each row of docs(doc_id, text).

    learns: which rows to learn from (null: not). score is the log10 probability of the text's ids and end under the
    model, base_score that of its words (A-Z lower-cased) and end under the unigram with one added to each count. A null
    or empty text is an end only; a null doc_id stays null; rows that repeat are scored each, and count each where they
    are learnt from. With nothing to learn from, the base is uniform and the model that of the priors. An empty table
    gives no rows; further columns are ignored. Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    size = tokenizer.get_vocab_size()
    end_id = tokenizer.token_to_id("<|endoftext|>")
    end_id = size - 1 if end_id is None else end_id
    stored = materialise(blocks(docs, learns, tokenizer_path))
    bits = max(1, (groups_of(docs, 1 << 27) - 1).bit_length())
    answers = materialise(word_counts(stored, bits))
    tokens, kinds = answers.where("block IS NULL").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()

    ends = np.array([(tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
    classes = Classes(counted_ids(stored, size, end_id), ends, end_id)
    shared = spark.sparkContext.broadcast(classes)  # two small arrays of the vocabulary's size
    after = After(classes, *counted_after(stored, shared))
    pairs = spark.sparkContext.broadcast(class_pairs(after.pairs))
    vector = initial()
    for turn in range(len(RATES)):
        vector, _ = trained(stored, shared, pairs, vector, turn)
    model = spark.sparkContext.broadcast((vector, after))  # at most CLASSES counts an id of the vocabulary

    def run(batches):
        weights, after = model.value
        own = Model(weights, pairs.value)
        for batch in batches:
            for k in range(batch.num_rows):
                n = _unpacked(batch.column("n_ids")[k], np.uint32).astype(np.int64)
                score = text_scores(own, after, _unpacked(batch.column("ids")[k], np.uint16).astype(np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column("block")[k].as_py())), pa.array(np.arange(len(n))), pa.array(score)], ["block", "i", "score"])

    scores = stored.select("block", "n_ids", "ids").mapInArrow(run, "block long, i long, score double")
    rows = word_sums(stored, answers).join(scores, ["block", "i"])
    base = F.col("log_sum") - F.col("n_tokens") * F.lit(float(np.log10(tokens + kinds + 1)))
    return rows.select("doc_id", "learns", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op12_attention(spark, sf_dir):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; a null doc_id is not held out.

    Odd rows as in `scored`.
    """
    import public_tokenizers

    held_out = F.coalesce(fold_of("doc_id", 7) == 2, F.lit(False))
    got = scored(table(spark, sf_dir, "documents"), ~held_out, public_tokenizers.path("word_bpe_49k.json"))
    return got.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
